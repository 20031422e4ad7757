"""Queries on id sets, stores of id sets, sorting and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph, idset
from ..sources import storage
from ..sources.domain import Domain, lat
from .registry import query


def _joined(c: Column) -> Column:
    return F.array_join(c, ",")


def _sets(d: Domain) -> DataFrame:
    """Nations as sets of market segments, twice: as named here and by region, so that sets repeat."""
    items = d.items()
    return items.select(F.col("cell_id").alias("key"), F.length("segment").cast("long").alias("item")).union(items.select(F.col("cell_id") + 100, F.length("segment").cast("long")))


@query("SELECT item_id FROM a UNION SELECT item_id FROM b")
def st1_union(d: Domain) -> DataFrame:
    return idset.union(d.set_a(), d.set_b())


@query("SELECT item_id FROM a INTERSECT SELECT item_id FROM b")
def st2_intersect(d: Domain) -> DataFrame:
    return idset.intersect(d.set_a(), d.set_b())


@query("SELECT item_id FROM a EXCEPT SELECT item_id FROM b")
def st3_difference(d: Domain) -> DataFrame:
    return idset.difference(d.set_a(), d.set_b())


@query("(SELECT item_id FROM a EXCEPT SELECT item_id FROM b) UNION (SELECT item_id FROM b EXCEPT SELECT item_id FROM a)")
def st4_symmetric_difference(d: Domain) -> DataFrame:
    return idset.symmetric_difference(d.set_a(), d.set_b())


@query("SELECT item_id FROM a INTERSECT SELECT item_id FROM b INTERSECT SELECT item_id FROM c")
def st5_nary_intersect(d: Domain) -> DataFrame:
    tagged = d.set_a().withColumn("term", F.lit(0)).union(d.set_b().withColumn("term", F.lit(1))).union(d.set_c().withColumn("term", F.lit(2)))
    return idset.in_all(tagged, "item_id", "term", 3)


@query("SELECT item_id FROM a UNION SELECT item_id FROM b UNION SELECT item_id FROM c")
def st6_nary_union(d: Domain) -> DataFrame:
    return idset.union(d.set_a(), d.set_b(), d.set_c())


@query("SELECT item_id FROM (SELECT item_id FROM a UNION SELECT item_id FROM b) ORDER BY item_id LIMIT 25")
def st7_unite_k(d: Domain) -> DataFrame:
    return idset.unite_k(d.set_a(), d.set_b(), 25)


@query("SELECT item_id FROM (SELECT item_id FROM a INTERSECT SELECT item_id FROM b EXCEPT SELECT item_id FROM c) WHERE (item_id * 7919) % 180001 >= 90000 ORDER BY item_id LIMIT 20")
def st8_fused_intersect_difference(d: Domain) -> DataFrame:
    return idset.and_minus_or([d.set_a(), d.set_b()], [d.set_c()], 20, lat(F.col("item_id")) >= 0)


@query("SELECT item_id FROM (SELECT item_id FROM a INTERSECT SELECT item_id FROM b) WHERE (item_id * 7919) % 180001 >= 90000 ORDER BY item_id LIMIT 20")
def st9_constrained_intersect(d: Domain) -> DataFrame:
    return idset.and_minus_or([d.set_a(), d.set_b()], [], 20, lat(F.col("item_id")) >= 0)


@query("SELECT row_id, coalesce(list_position(x, x[1]), 0) - 1 AS place, CAST(coalesce(list_contains(y, x[1]), false) AS BIGINT) AS hits FROM arrs")
def st10_find(d: Domain) -> DataFrame:
    first = F.get("x", F.lit(0))
    return d.arrays().select("row_id", (F.coalesce(F.array_position("x", first), F.lit(0)) - 1).cast("int").alias("place"), F.coalesce(F.array_contains("y", first), F.lit(False)).cast("long").alias("hits"))


@query("SELECT row_id, x[1] AS front, x[-1] AS back, x[2] AS at1, CAST(len(x) AS BIGINT) AS n FROM arrs")
def st11_positional(d: Domain) -> DataFrame:
    return d.arrays().select("row_id", F.array_min("x").alias("front"), F.array_max("x").alias("back"), F.get("x", F.lit(1)).alias("at1"), F.size("x").cast("long").alias("n"))


@query("SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place FROM a")
def st11_rank(d: Domain) -> DataFrame:
    return idset.ranked(d.set_a()).select("item_id", F.col("position").cast("long").alias("place"))


@query("SELECT range AS item_id FROM range(5, 500, 7)")
def st12_range(d: Domain) -> DataFrame:
    return d.spark.range(5, 500, 7).toDF("item_id")


@query("SELECT (item_id + 1 - 1) // 32768 + 1 AS bucket, count(DISTINCT item_id) AS n FROM a GROUP BY 1")
def st13_bitset(d: Domain) -> DataFrame:
    """Ids to bitmaps per bucket and back to counts."""
    return idset.bitmap(d.set_a()).select("bucket", F.bitmap_count("bits").alias("n"))


@query(
    """SELECT coalesce(x.k, y.k) AS bucket, coalesce(x.n, 0) AS n_or, coalesce(y.n, 0) AS n_and FROM
  (SELECT item_id // 32768 + 1 AS k, count(*) AS n FROM (SELECT item_id FROM a UNION SELECT item_id FROM b) GROUP BY 1) x
  FULL JOIN (SELECT item_id // 32768 + 1 AS k, count(*) AS n FROM (SELECT item_id FROM a INTERSECT SELECT item_id FROM b) GROUP BY 1) y ON x.k = y.k"""
)
def st14_bitset_ops(d: Domain) -> DataFrame:
    """OR and AND of bitmaps; a bucket that only one side has is empty in the AND."""
    both = idset.bitmap(d.set_a()).union(idset.bitmap(d.set_b()))
    return both.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n_or"), F.when(F.count(F.lit(1)) > 1, F.bitmap_count(F.bitmap_and_agg("bits"))).otherwise(F.lit(0)).cast("long").alias("n_and"))


@query("SELECT item_id FROM items EXCEPT SELECT item_id FROM a")
def st14_complement(d: Domain) -> DataFrame:
    return idset.difference(d.items().select("item_id"), d.set_a())


@query("SELECT min(item_id) AS least, max(item_id) AS most, count(*) AS n FROM a")
def st15_bitset_extent(d: Domain) -> DataFrame:
    return d.set_a().agg(F.min("item_id").alias("least"), F.max("item_id").alias("most"), F.count("item_id").alias("n"))


@query("SELECT row_id, CAST(len(list_intersect(x, y)) AS BIGINT) AS n FROM arrs")
def st16_intersection_size(d: Domain) -> DataFrame:
    return d.arrays().select("row_id", F.size(F.array_intersect("x", "y")).cast("long").alias("n"))


@query("SELECT row_id, len(list_intersect(x, y)) = len(x) AS inside, len(list_intersect(x, y)) = len(x) AND len(x) < len(y) AS strictly FROM arrs")
def st17_subset(d: Domain) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return d.arrays().select("row_id", idset.subset(x, y).alias("inside"), idset.subset(x, y, True).alias("strictly"))


@query("SELECT row_id, len(list_intersect(x, y)) > 0 AS overlap FROM arrs")
def st18_common_value(d: Domain) -> DataFrame:
    return d.arrays().select("row_id", F.arrays_overlap("x", "y").alias("overlap"))


@query("SELECT row_id, x = y AS same, x <> y AS differ FROM arrs")
def st19_equality(d: Domain) -> DataFrame:
    return d.arrays().select("row_id", (F.col("x") == F.col("y")).alias("same"), (F.col("x") != F.col("y")).alias("differ"))


@query(
    """SELECT row_id, coalesce(array_to_string(list_sort(list_distinct(list_concat(x, y))), ','), '') AS u, coalesce(array_to_string(list_sort(list_intersect(x, y)), ','), '') AS i,
  coalesce(array_to_string(list_sort([v FOR v IN x IF NOT list_contains(y, v)]), ','), '') AS d,
  coalesce(array_to_string(list_sort(list_concat([v FOR v IN x IF NOT list_contains(y, v)], [v FOR v IN y IF NOT list_contains(x, v)])), ','), '') AS s FROM arrs"""
)
def st20_lazy_setops(d: Domain) -> DataFrame:
    """The four operations on sorted arrays, row by row."""
    x, y = F.col("x"), F.col("y")
    return d.arrays().select("row_id", _joined(idset.array_union(x, y)).alias("u"), _joined(idset.array_intersect(x, y)).alias("i"), _joined(idset.array_difference(x, y)).alias("d"), _joined(idset.array_symmetric_difference(x, y)).alias("s"))


@query("SELECT row_id, CAST(len(x) + len(y) AS BIGINT) AS most_union, CAST(least(len(x), len(y)) AS BIGINT) AS most_intersect, CAST(len(x) AS BIGINT) AS most_difference FROM arrs")
def st20_bounds(d: Domain) -> DataFrame:
    """Upper bounds of what a set operation returns, without running it."""
    n, m = F.size("x").cast("long"), F.size("y").cast("long")
    return d.arrays().select("row_id", (n + m).alias("most_union"), F.least(n, m).alias("most_intersect"), n.alias("most_difference"))


@query("SELECT row_id, list_sort(list_distinct(list_concat(x, y))) = list_concat(x, y) AS ascending, len(list_distinct(list_concat(x, y))) = len(x) + len(y) AS is_unique FROM arrs")
def st21_monotone(d: Domain) -> DataFrame:
    both = F.concat("x", "y")
    return d.arrays().select("row_id", idset.strictly_ascending(both).alias("ascending"), (F.size(F.array_distinct(both)) == F.size(both)).alias("is_unique"))


@query("SELECT DISTINCT o_custkey AS item_id FROM orders WHERE o_orderpriority = '1-URGENT'")
def st22_remap(d: Domain) -> DataFrame:
    o = d.table("orders")
    return idset.remap(o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("item_id")), o, "o_orderkey", "o_custkey")


def _least_labels(rounds: int) -> str:
    """Least labels of neighbours, ``rounds`` times over: enough for components of that diameter, which the tables' lines don't reach."""
    first = ", links AS (SELECT DISTINCT l_orderkey AS u, 1000000000 + l_partkey AS v FROM lineitem), ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links), l0 AS (SELECT u AS n, u AS m FROM ways GROUP BY 1, 2)"
    step = ", l{1} AS MATERIALIZED (SELECT n, min(m) AS m FROM (SELECT n, m FROM l{0} UNION ALL SELECT v, m FROM ways JOIN l{0} ON u = n) GROUP BY 1)"
    return first + "".join(step.format(k, k + 1) for k in range(rounds)) + f" SELECT n AS node, m AS root FROM l{rounds}"


@query(_least_labels(24))
def st23_union_find(d: Domain) -> DataFrame:
    """Orders and parts that lines connect; each with the least node of its component."""
    links = d.table("lineitem").select(F.col("l_orderkey").alias("u"), (F.col("l_partkey") + 1000000000).alias("v"))
    return graph.components(links)


# storage


@query("SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM customer GROUP BY 1")
def io1_byte_views(d: Domain) -> DataFrame:
    """Read through a path that any file system of the cluster may serve; only two columns are read."""
    return d.table("customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("s"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def io2_write_read(d: Domain) -> DataFrame:
    return storage.cut(d.table("customer"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1")
def io3_chunked_read(d: Domain) -> DataFrame:
    """A range of dates: row groups outside it are skipped by their statistics."""
    return d.table("orders").where("o_orderdate >= timestamp_ntz'1995-01-01'").groupBy(F.col("o_orderstatus").alias("status")).count().withColumnRenamed("count", "n")


@query("SELECT codec, n, s FROM (SELECT count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS s FROM supplier) CROSS JOIN (VALUES ('zstd'), ('snappy'), ('gzip'), ('uncompressed')) t(codec)")
def io4_compressed(d: Domain) -> DataFrame:
    out = None
    for codec in storage.CODECS:
        got = d.spark.read.parquet(storage.store(d.table("supplier"), codec)).agg(F.lit(codec).alias("codec"), F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("s"))
        out = got if out is None else out.union(got)
    return out.select("codec", "n", "s")


@query("SELECT kind, n FROM (SELECT count(*) AS n FROM supplier) CROSS JOIN (VALUES ('program'), ('shared'), ('fast_file'), ('slow_file')) t(kind)")
def io5_temp_storage(d: Domain) -> DataFrame:
    out = None
    for kind, level in storage.LEVELS.items():
        kept = d.table("supplier").persist(level)
        got = storage.cut(kept.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")))
        kept.unpersist()
        out = got if out is None else out.union(got)
    return out


@query("SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1")
def io6_compressor(d: Domain) -> DataFrame:
    parts = d.spark.read.parquet(storage.store(d.table("part").select("p_brand"), "gzip"))
    return parts.groupBy(F.col("p_brand").alias("brand")).count().withColumnRenamed("count", "n")


_SETS = """, ks AS (SELECT DISTINCT cell_id AS key, CAST(length(segment) AS BIGINT) AS item FROM items UNION SELECT cell_id + 100, CAST(length(segment) AS BIGINT) FROM items),
named AS (SELECT key, array_to_string(list_sort(list(item)), ',') AS s FROM ks GROUP BY 1),
ids AS (SELECT s, dense_rank() OVER (ORDER BY min(key)) AS idx_id, min(key) AS k FROM named GROUP BY s) """


@query(_SETS + "SELECT key, idx_id FROM named JOIN ids USING (s)")
def io8_index_build(d: Domain) -> DataFrame:
    """Equal sets share an id."""
    _, ids = storage.index_store(_sets(d), "key", "item")
    return ids.select("key", "idx_id")


@query(_SETS + "SELECT idx_id, item AS item_id, count(*) OVER (PARTITION BY idx_id) AS n FROM ids JOIN ks ON ks.key = ids.k")
def io7_index_read(d: Domain) -> DataFrame:
    """Every stored set with its size."""
    stored, _ = storage.index_store(_sets(d), "key", "item")
    stored = storage.cut(stored)
    return stored.join(stored.groupBy("idx_id").agg(F.count(F.lit(1)).alias("n")), "idx_id")


@query(
    """, n1 AS (SELECT key, array_to_string(list_sort(list(item)), ',') AS s FROM (SELECT DISTINCT cell_id AS key, CAST(length(segment) AS BIGINT) AS item FROM items) GROUP BY 1),
n2 AS (SELECT s_nationkey AS key, array_to_string(list_sort(list(DISTINCT CAST(9 AS BIGINT))), ',') AS s FROM supplier GROUP BY 1)
SELECT count(DISTINCT s) AS n_sets, CAST((SELECT count(DISTINCT s) FROM n1) + (SELECT count(DISTINCT s) FROM n2) AS BIGINT) AS n_before FROM (SELECT s FROM n1 UNION ALL SELECT s FROM n2)"""
)
def io9_merge_stores(d: Domain) -> DataFrame:
    items = d.items()
    one, _ = storage.index_store(items.select(F.col("cell_id").alias("key"), F.length("segment").cast("long").alias("item")), "key", "item")
    two, _ = storage.index_store(d.table("supplier").select(F.col("s_nationkey").alias("key"), F.lit(9).cast("long").alias("item")), "key", "item")
    _, ids = storage.merge_stores(one, two)
    return ids.agg(F.countDistinct("idx_id").alias("n_sets"), F.count(F.lit(1)).alias("n_before"))


@query(_SETS + "SELECT count(*) AS n_sets, CAST(sum(n) AS BIGINT) AS n_items, min(n) AS least, max(n) AS most FROM (SELECT idx_id, count(*) AS n FROM ids JOIN ks ON ks.key = ids.k GROUP BY 1)")
def io11_inspect(d: Domain) -> DataFrame:
    stored, _ = storage.index_store(_sets(d), "key", "item")
    return stored.groupBy("idx_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_sets"), F.sum("n").alias("n_items"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("SELECT cell_id, CAST(5 AS BIGINT) AS n_points, round(lat - 20.0005, 6) AS first_lat, round(lon - 20.0005, 6) AS left_lon FROM cells")
def io12_point_chains(d: Domain) -> DataFrame:
    chains = storage.cut(d.diamonds().select("poly_id", "ring"))
    return chains.select(F.col("poly_id").alias("cell_id"), F.size("ring").cast("long").alias("n_points"), F.round(F.col("ring")[0]["lat"], 6).alias("first_lat"), F.round(F.col("ring")[3]["lon"], 6).alias("left_lon"))


@query("SELECT s_suppkey, s_name FROM supplier")
def io13_version_check(d: Domain) -> DataFrame:
    s = d.table("supplier").select("s_suppkey", "s_name")
    return storage.open_checked(d.spark, storage.store(s), s.schema)


# sorting and limits


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber")
def so1_sort(d: Domain) -> DataFrame:
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def so2_unique(d: Domain) -> DataFrame:
    return d.table("lineitem").select("l_partkey", "l_suppkey").dropDuplicates()


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part")
def so3_sorted_runs(d: Domain) -> DataFrame:
    from pyspark.sql.window import Window

    by = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return d.table("part").select("p_brand", "p_partkey", F.row_number().over(by).cast("long").alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def so4_top_k(d: Domain) -> DataFrame:
    return d.table("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("SELECT segment, n FROM (SELECT segment, count(*) AS n FROM items GROUP BY 1)")
def ca1_cache(d: Domain) -> DataFrame:
    """A small aggregate that is kept for those who ask again."""
    kept = d.items().groupBy("segment").agg(F.count(F.lit(1)).alias("n")).persist(storage.LEVELS["shared"])
    first, again = storage.cut(kept), storage.cut(kept)
    kept.unpersist()
    return first.union(again).distinct()


@query("SELECT o_custkey AS item_id, count(*) AS n FROM orders WHERE o_custkey IN (SELECT item_id FROM a) GROUP BY 1")
def ca2_filtered_hash(d: Domain) -> DataFrame:
    """Members of a set, counted: a semi join, for which Spark may build a Bloom filter, and a hash aggregate."""
    a = d.set_a()
    o = d.table("orders").select(F.col("o_custkey").alias("item_id"))
    return o.join(a, "item_id", "left_semi").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
