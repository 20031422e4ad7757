"""Tables, and the search domain that is derived from them: items, cells, regions, coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that a table must have; a load with others missing fails at once.
SCHEMAS = {
    "region": {"r_regionkey", "r_name"},
    "nation": {"n_nationkey", "n_name", "n_regionkey"},
    "customer": {"c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"},
    "supplier": {"s_suppkey", "s_name", "s_nationkey", "s_acctbal"},
    "part": {"p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"},
    "orders": {"o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"},
    "lineitem": {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"},
    "events": {"event_id", "ts", "user_id", "event_type", "value", "props"},
    "documents": {"doc_id", "text", "lang", "source", "n_chars"},
}


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    frame = spark.read.parquet(f"{folder}/{table}.parquet")
    if missing := SCHEMAS.get(table, set()) - set(frame.columns):
        raise ValueError(f"{table} lacks {sorted(missing)}")
    return frame


def lat(key: Column) -> Column:
    return F.lit(-90e0) + ((key.cast("long") * 7919) % 180001) / F.lit(1000e0)


def lon(key: Column) -> Column:
    return F.lit(-180e0) + ((key.cast("long") * 104729) % 360001) / F.lit(1000e0)


class Domain:
    """Customers are placed items of one cell, parts text items of many; nations are cells, and the leaves of a region DAG.

    Above a nation stand its region and the half of the world by the parity of its key; above both the root, 99.
    """

    #: Half a diamond's width: no point of the domain is on its edge.
    SPAN = 20.0005

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)

    def values(self, schema: str, *rows: tuple) -> DataFrame:
        """A small literal table; it stays in the plan, as a local relation."""
        names = [c.split()[0] for c in schema.split(",")]
        kinds = [c.split()[1] for c in schema.split(",")]
        lit = lambda v, kind: F.lit(v).cast(kind)
        structs = [F.struct(*[lit(v, k).alias(n) for v, k, n in zip(r, kinds, names, strict=True)]) for r in rows]
        return self.spark.range(1).select(F.inline(F.array(*structs)))

    def items(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(key.alias("item_id"), F.col("c_nationkey").cast("long").alias("cell_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal"), lat(key).alias("lat"), lon(key).alias("lon"))

    def set_a(self) -> DataFrame:
        return self.items().where("segment = 'BUILDING'").select("item_id")

    def set_b(self) -> DataFrame:
        return self.items().where("bal >= 5000").select("item_id")

    def set_c(self) -> DataFrame:
        return self.items().where("cell_id < 10").select("item_id")

    def parts(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("item_id"), F.array("p_name", "p_brand", "p_type").alias("strs"))

    def part_strs(self) -> DataFrame:
        """``item_id, s``: a row for each string of an item."""
        return self.parts().select("item_id", F.explode("strs").alias("s"))

    def universe(self) -> DataFrame:
        """``item_id, cell_id``: parts in the nations of their suppliers, an item in many cells."""
        s = self.table("supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("cell_id"))
        pairs = self.table("lineitem").select("l_partkey", "l_suppkey").distinct()
        return pairs.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("item_id"), "cell_id").distinct()

    def arrays(self) -> DataFrame:
        """``row_id, x, y``: two sorted arrays of parts for each order, which has a few lines."""
        of = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("l_partkey"))))
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(of(F.col("l_quantity") >= 25).alias("x"), of(F.col("l_discount") >= 0.05).alias("y"))

    def cells(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.table("nation").select(key.cast("long").alias("cell_id"), lat(key).alias("lat"), lon(key).alias("lon"))

    def regions(self) -> DataFrame:
        """``region_id, name``: children have smaller ids than parents."""
        r = self.table("region").select((F.col("r_regionkey") + 30).cast("long").alias("region_id"), F.col("r_name").alias("name"))
        n = self.table("nation").select(F.col("n_nationkey").cast("long").alias("region_id"), F.col("n_name").alias("name"))
        return n.union(r).union(self.values("region_id long, name string", (40, "EVEN"), (41, "ODD"), (99, "WORLD")))

    def region_parents(self) -> DataFrame:
        """``child, parent``, the root's children included."""
        n = self.table("nation")
        up = n.select(F.col("n_nationkey").cast("long").alias("child"), (F.col("n_regionkey") + 30).cast("long").alias("parent"))
        half = n.select(F.col("n_nationkey").cast("long").alias("child"), (F.col("n_nationkey") % 2 + 40).cast("long").alias("parent"))
        top = up.select(F.col("parent").alias("child")).union(half.select("parent")).distinct().withColumn("parent", F.lit(99).cast("long"))
        return up.union(half).union(top)

    def cell_parents(self) -> DataFrame:
        """``cell_id, region_id``: every region that holds the cell, ancestors included."""
        own = self.cells().select("cell_id", F.col("cell_id").alias("region_id"))
        above = self.region_parents().where("child < 30").select(F.col("child").alias("cell_id"), F.col("parent").alias("region_id"))
        return own.union(above).union(self.cells().select("cell_id", F.lit(99).cast("long"))).distinct()

    def cell_edges(self) -> DataFrame:
        """Nation i borders (i + 1) % 25 and (i + 5) % 25, both ways."""
        one = self.cells().select(F.col("cell_id").alias("src"), F.explode(F.array((F.col("cell_id") + 1) % 25, (F.col("cell_id") + 5) % 25)).alias("dst"))
        return one.union(one.select("dst", "src")).distinct()

    def diamonds(self) -> DataFrame:
        """``poly_id, ring``: a closed diamond around each nation's centre, ``SPAN`` degrees from it to each corner."""
        r = self.SPAN
        at = lambda dy, dx: F.struct((F.col("lat") + F.lit(float(dy))).alias("lat"), (F.col("lon") + F.lit(float(dx))).alias("lon"))
        return self.cells().select(F.col("cell_id").alias("poly_id"), "lat", "lon", F.array(at(-r, 0), at(0, r), at(r, 0), at(0, -r), at(-r, 0)).alias("ring"))
