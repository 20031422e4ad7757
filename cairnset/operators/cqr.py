"""Cell query results: ``cell_id, full_match, item_id``, long form; ``item_id`` is null iff the cell matches in full.

Joins are on the cell and item ids; cell sizes come from one aggregate. A cell is full or partial, never both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def build(full_cells: DataFrame, partial: DataFrame) -> DataFrame:
    """Full cells win over partial ones."""
    full = all_to_full(full_cells)
    rest = partial.select("cell_id", "item_id").distinct().join(full, "cell_id", "left_anti")
    return full.union(rest.select("cell_id", F.lit(False), "item_id"))


def _full(r: DataFrame) -> DataFrame:
    return r.where("full_match").select("cell_id")


def _part(r: DataFrame) -> DataFrame:
    return r.where("not full_match").select("cell_id", "item_id")


def expand(r: DataFrame, universe: DataFrame) -> DataFrame:
    """``cell_id, item_id`` with full cells' items spelled out."""
    return _part(r).union(_full(r).join(universe, "cell_id").select("cell_id", "item_id"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    both = _full(a).join(_full(b), "cell_id", "left_semi")
    part = _part(a).join(_full(b), "cell_id", "left_semi").union(_part(b).join(_full(a), "cell_id", "left_semi")).union(_part(a).join(_part(b), ["cell_id", "item_id"], "left_semi"))
    return build(both, part)


def union(a: DataFrame, b: DataFrame, universe: DataFrame) -> DataFrame:
    """Partial sets that both sides list and that reach the cell's size become full; a cell that one side lists stays as it is."""
    full = _full(a).union(_full(b)).distinct()
    part = _part(a).union(_part(b)).distinct()
    sizes = universe.groupBy("cell_id").agg(F.countDistinct("item_id").alias("_all"))
    shared = _part(a).select("cell_id").distinct().join(_part(b).select("cell_id").distinct(), "cell_id", "left_semi")
    got = part.join(shared, "cell_id", "left_semi").groupBy("cell_id").agg(F.count("item_id").alias("_n"))
    return build(full.union(got.join(sizes, "cell_id").where("_n = _all").select("cell_id")), part)


def difference(a: DataFrame, b: DataFrame, universe: DataFrame) -> DataFrame:
    """A full cell that the right side doesn't list stays full."""
    untouched = _full(a).join(b.select("cell_id").distinct(), "cell_id", "left_anti")
    touched = a.join(untouched, "cell_id", "left_anti").join(_full(b), "cell_id", "left_anti")
    part = expand(touched, universe).join(_part(b), ["cell_id", "item_id"], "left_anti")
    return build(untouched, part)


def symmetric_difference(a: DataFrame, b: DataFrame, universe: DataFrame) -> DataFrame:
    only = lambda x, y: x.join(y.select("cell_id").distinct(), "cell_id", "left_anti")
    full = _full(only(a, b)).union(_full(only(b, a)))
    keep = lambda x: x.join(full, "cell_id", "left_anti")
    tagged = expand(keep(a), universe).withColumn("_s", F.lit(1)).union(expand(keep(b), universe).withColumn("_s", F.lit(2)))
    return build(full, tagged.groupBy("cell_id", "item_id").agg(F.sum("_s").alias("_s")).where("_s < 3"))


def all_to_full(a: DataFrame) -> DataFrame:
    return a.select("cell_id").distinct().select("cell_id", F.lit(True).alias("full_match"), F.lit(None).cast("long").alias("item_id"))


def flatten(a: DataFrame, universe: DataFrame) -> DataFrame:
    return expand(a, universe).select("item_id").distinct()


def top_k(a: DataFrame, universe: DataFrame, k: int) -> DataFrame:
    return flatten(a, universe).orderBy("item_id").limit(k)


def sizes(a: DataFrame, universe: DataFrame) -> DataFrame:
    """``cell_id, full_match, n``: items of each listed cell."""
    return expand(a, universe).groupBy("cell_id").agg(F.count("item_id").alias("n")).join(a.select("cell_id", "full_match").distinct(), "cell_id")


def ranks(universe: DataFrame) -> DataFrame:
    """``cell_id, item_id, local_id``: ranks within the cell. Ranges of ids are ranked apart and offset by the ranges before, so that no window holds a large cell."""
    rows = universe.select("cell_id", "item_id").distinct().withColumn("_b", F.floor(F.col("item_id") / (1 << 16)))
    before = Window.partitionBy("cell_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("cell_id", "_b").count().select("cell_id", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("cell_id", "_b").orderBy("item_id")) - 1
    return rows.withColumn("_p", place).join(offsets, ["cell_id", "_b"]).select("cell_id", "item_id", (F.col("_p") + F.col("_o")).alias("local_id"))


def to_local(a: DataFrame, universe: DataFrame) -> DataFrame:
    """Item ids as ranks within their cell."""
    return _part(a).join(ranks(universe), ["cell_id", "item_id"]).select("cell_id", "local_id")


def to_global(local: DataFrame, universe: DataFrame) -> DataFrame:
    """``cell_id, local_id, item_id``."""
    return local.join(ranks(universe), ["cell_id", "local_id"]).select("cell_id", "local_id", "item_id")


def remove_empty(a: DataFrame) -> DataFrame:
    return a.where("full_match or item_id is not null")


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two results has: none if they are equal."""
    cols = a.columns
    tagged = a.withColumn("_s", F.lit(1)).union(b.select(*cols).withColumn("_s", F.lit(-1)))
    return tagged.groupBy(*cols).agg(F.sum("_s").alias("_s")).where("_s <> 0").select(*cols)


def self_check(a: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows that break an invariant: full with an item, partial without, both in a cell, or an item that isn't in the cell."""
    shape = a.where("full_match = (item_id is not null)")
    mixed = a.groupBy("cell_id").agg(F.countDistinct("full_match").alias("n")).where("n > 1").select("cell_id", F.lit(None).cast("boolean"), F.lit(None).cast("long"))
    return shape.union(mixed).union(_part(a).join(universe, ["cell_id", "item_id"], "left_anti").select("cell_id", F.lit(False), "item_id"))
