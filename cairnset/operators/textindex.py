"""Completion over items, regions and cells. Items are ``item_id, s`` rows, regions ``region_id, name``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.storage import cut
from . import cqr


def complete(strs: DataFrame, q: str, kind: int) -> DataFrame:
    """Ids of the items of which a string matches."""
    return strs.where(text.matches(F.col("s"), q, kind)).select("item_id").distinct()


def next_characters(strs: DataFrame, q: str) -> DataFrame:
    """``c, item_id``: characters that follow the prefix, with the items that have them."""
    return strs.select("item_id", text.next_char(F.col("s"), q).alias("c")).where("c is not null").distinct()


def flattened(strs: DataFrame, regions: DataFrame, cell_parents: DataFrame, item_cells: DataFrame, q: str, kind: int) -> DataFrame:
    """Matching items, and all items of matching regions."""
    hit = regions.where(text.matches(F.col("name"), q, kind)).select("region_id")
    inside = item_cells.join(cell_parents.join(hit, "region_id", "left_semi").select("cell_id").distinct(), "cell_id", "left_semi")
    return complete(strs, q, kind).union(inside.select("item_id")).distinct()


def region_cells(regions: DataFrame, cell_parents: DataFrame, q: str, kind: int) -> DataFrame:
    """Cells of matching regions, in full."""
    hit = regions.where(text.matches(F.col("name"), q, kind)).select("region_id")
    return cqr.all_to_full(cell_parents.join(hit, "region_id", "left_semi").select("cell_id"))


def item_cells(strs: DataFrame, universe: DataFrame, q: str, kind: int) -> DataFrame:
    """Cells of matching items, with those items."""
    return cqr.build(universe.where("false"), universe.join(complete(strs, q, kind), "item_id", "left_semi"))


def complete_cells(strs: DataFrame, universe: DataFrame, regions: DataFrame, cell_parents: DataFrame, q: str, kind: int) -> DataFrame:
    """Regions give full cells, items partial ones; full wins."""
    return cqr.build(region_cells(regions, cell_parents, q, kind), universe.join(complete(strs, q, kind), "item_id", "left_semi"))


def index(strs: DataFrame) -> DataFrame:
    """``node, kind, s``: nodes under which a string is found, made once for each distinct string.

    A string is the exact match of itself, a prefix match of its prefixes, a suffix match of its suffixes and a substring match of the prefixes of these.
    """
    s = strs.select("s").distinct().where(F.length("s") > 0)
    ends = s.select("s", F.explode(text.suffixes(F.col("s"))).alias("e"))
    exact = s.select(F.col("s").alias("node"), F.lit(text.EXACT).alias("kind"), "s")
    prefix = s.select(F.explode(text.prefixes(F.col("s"))).alias("node"), F.lit(text.PREFIX), "s")
    suffix = ends.select("e", F.lit(text.SUFFIX), "s")
    inner = ends.select(F.explode(text.prefixes(F.col("e"))).alias("node"), F.lit(text.SUBSTRING), "s")
    return exact.union(prefix).union(suffix).union(inner).distinct()


#: Characters of a suffix that are kept in the table of suffixes.
WIDTH = 16


class Suffixes:
    """A stored index that answers exact, prefix, suffix and substring queries: the strings, and the first ``WIDTH`` characters of each of their suffixes, in order.

    A string of n characters has n short rows, whatever its length. A query is a range of the ordered table: of its row groups those are read whose bounds
    hold the query's beginning; longer queries are checked against the strings found.
    """

    def __init__(self, strs: DataFrame):
        named = cut(strs.select("s").distinct().where(F.length("s") > 0).withColumn("sid", F.xxhash64("s", F.length("s"))))
        at = named.select("sid", F.length("s").alias("n"), F.explode(F.sequence(F.lit(1), F.length("s"))).alias("at"), "s")
        rows = at.select(F.substring("s", F.col("at"), F.lit(WIDTH)).alias("key"), "sid", "at", (F.col("n") - F.col("at") + 1).alias("size"))
        self.strs, self.named = cut(strs.where(F.length("s") > 0).withColumn("sid", F.xxhash64("s", F.length("s"))).select("item_id", "sid")), named
        self.rows = cut(rows.repartitionByRange("key").sortWithinPartitions("key"))

    def strings(self, q: str, kind: int) -> DataFrame:
        """``sid, s`` of the strings that match; an empty query matches all."""
        if not q:
            return self.named.select("sid", "s").where(F.lit(not kind & text.EXACT))
        hit = self.rows.where(F.startswith("key", F.lit(q[:WIDTH])))
        if kind & (text.EXACT | text.PREFIX):
            hit = hit.where("at = 1")
        if kind & (text.EXACT | text.SUFFIX):
            hit = hit.where(F.col("size") == len(q))
        found = hit.select("sid", "at").join(self.named, "sid")
        return found.where(F.substring("s", F.col("at"), F.lit(len(q))) == q).select("sid", "s").distinct()

    def items(self, q: str, kind: int) -> DataFrame:
        return self.strs.join(self.strings(q, kind), "sid", "left_semi").select("item_id").distinct()

    def counts(self, q: str, kind: int) -> DataFrame:
        """``s, n``: the strings that match, with the number of their rows."""
        return self.strs.join(self.strings(q, kind), "sid").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
