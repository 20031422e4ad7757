"""Cell query results on a hierarchical grid: cells are pixels of several levels.

Level l has 2^l x 2^l pixels over the world; a pixel's id is ``tile << 8 | level`` with ``tile = y * 2^l + x``, x by latitude.
A result has the columns of a cell query result, its cells being leaves that don't overlap. Set operations are those of ``cqr`` on the pieces that the leaves of both
sides cut the world into; ``compactified`` makes four full children their parent.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import grid_bin
from ..sources.storage import cut
from . import cqr


def pixel(lat: Column, lon: Column, level: int) -> Column:
    n = 1 << level
    return F.shiftleft(grid_bin(lat, lon, -90.0, 90.0, -180.0, 180.0, n, n).cast("long"), 8) + level


def level_of(p: Column) -> Column:
    return p.bitwiseAND(F.lit(255)).cast("int")


def place(p: Column) -> tuple[Column, Column]:
    """x and y of a pixel at its level."""
    n = F.pow(F.lit(2.0), level_of(p)).cast("long")
    tile = F.shiftright(p, 8)
    return tile % n, F.floor(tile / n).cast("long")


def at(x: Column, y: Column, level: Column) -> Column:
    return F.shiftleft(y * F.pow(F.lit(2.0), level).cast("long") + x, 8) + level


def ancestor(p: Column, level: int) -> Column:
    """The pixel of ``level`` that holds ``p``; ``p`` itself if it isn't below that level."""
    x, y = place(p)
    by = F.pow(F.lit(2.0), level_of(p) - level).cast("long")
    return F.when(level_of(p) <= level, p).otherwise(at(F.floor(x / by).cast("long"), F.floor(y / by).cast("long"), F.lit(level)))


def children(p: Column) -> Column:
    x, y = place(p)
    return F.array(*[at(x * 2 + i, y * 2 + j, level_of(p) + 1) for j in (0, 1) for i in (0, 1)])


def descendants(p: Column, level: int) -> Column:
    """All pixels of ``level`` in ``p``."""
    x, y = place(p)
    k = F.pow(F.lit(2.0), F.greatest(F.lit(level) - level_of(p), F.lit(0))).cast("long")
    steps = F.sequence(F.lit(0).cast("long"), k - 1)
    deep = F.flatten(F.transform(steps, lambda j: F.transform(steps, lambda i: at(x * k + i, y * k + j, F.lit(level)))))
    return F.when(level_of(p) >= level, F.array(p)).otherwise(deep)


def ancestors(p: Column, deepest: int) -> Column:
    """``p`` and all pixels above it; it is at level ``deepest`` or above."""
    return F.array_compact(F.array(*[F.when(level_of(p) >= k, ancestor(p, k)) for k in range(deepest + 1)]))


def expanded(a: DataFrame, item_pixels: DataFrame, level: int) -> DataFrame:
    """Leaves above ``level`` pushed down to it, a level at a time. ``item_pixels``: ``item_id, cell_id`` at that level or below."""
    p = F.col("cell_id")
    full = a.where("full_match").select("cell_id")
    for _ in range(level):
        full = full.select(F.explode(F.when(level_of(p) < level, children(p)).otherwise(F.array(p))).alias("cell_id"))
    part = a.where("not full_match")
    deep = part.where(level_of(p) >= level).select("cell_id", "item_id")
    own = item_pixels.select("item_id", ancestor(p, level).alias("_to"), F.explode(ancestors(ancestor(p, level), level)).alias("cell_id"))
    high = part.where(level_of(p) < level).join(own, ["item_id", "cell_id"]).select(F.col("_to").alias("cell_id"), "item_id")
    return cqr.build(full, deep.union(high))


def compactified(a: DataFrame, deepest: int) -> DataFrame:
    """Four full children become their parent, level by level; what is written at a level are its own pixels."""
    p = F.col("cell_id")
    full = cut(a.where("full_match").select("cell_id").distinct())
    done = [full.where((level_of(p) == 0) | (level_of(p) > deepest))]
    risen = full.where("false")
    for level in range(deepest, 0, -1):
        here = cut(full.where(level_of(p) == level).union(risen).withColumn("up", ancestor(p, level - 1)))
        risen = here.groupBy("up").count().where("count = 4").select("up")
        done.append(here.join(risen, "up", "left_anti").select("cell_id"))
        risen = risen.select(F.col("up").alias("cell_id"))
    return cqr.all_to_full(reduce(DataFrame.union, [*done, risen])).union(a.where("not full_match"))


def tree(a: DataFrame, deepest: int) -> DataFrame:
    """``cell_id, level, kind``: leaves (full or partial) and all pixels above them (inner)."""
    leaves = a.groupBy("cell_id").agg(F.bool_or("full_match").alias("f")).select("cell_id", F.when(F.col("f"), "full").otherwise("partial").alias("kind"))
    p = F.col("cell_id")
    above = F.array(*[F.when(level_of(p) > k, ancestor(p, k)) for k in range(deepest)])
    inner = leaves.select(F.explode(F.array_compact(above)).alias("cell_id")).distinct().withColumn("kind", F.lit("inner"))
    return leaves.union(inner).select("cell_id", level_of(F.col("cell_id")).alias("level"), "kind")


def pieces(leaves: DataFrame, deepest: int) -> DataFrame:
    """``cell_id``: the coarsest pixels that cut the world so that each of ``leaves`` (``cell_id``) is made of whole ones: of the pixels above a leaf the
    children that aren't above one themselves. At most four for each pixel above a leaf, however deep leaves are."""
    p = F.col("cell_id")
    above = cut(leaves.select(F.explode(ancestors(p, deepest)).alias("up"), "cell_id").where(F.col("up") != p).select(F.col("up").alias("cell_id")).distinct())
    world = leaves.sparkSession.range(1).select(F.lit(0).cast("long").alias("cell_id"))
    return above.select(F.explode(children(p)).alias("cell_id")).union(world).join(above, "cell_id", "left_anti")


def split(a: DataFrame, into: DataFrame, owners: DataFrame) -> DataFrame:
    """``a`` on pieces: a full leaf fills its pieces, the items of a partial one go where they are. ``into``: ``cell_id, up`` of each piece with all pixels from itself
    upwards; ``owners``: ``item_id, cell_id``, the piece of each item."""
    leaves = a.select(F.col("cell_id").alias("up"), "full_match").distinct()
    mine = into.join(leaves, "up")
    part = a.where("not full_match").select(F.col("cell_id").alias("up"), "item_id")
    whole = part.join(mine.where("up = cell_id").select("up"), "up", "left_semi").select(F.col("up").alias("cell_id"), "item_id")
    cut_up = part.join(mine.where("not full_match and up <> cell_id").select("up", "cell_id"), "up").join(owners, ["cell_id", "item_id"], "left_semi").select("cell_id", "item_id")
    return cqr.build(mine.where("full_match").select("cell_id"), whole.union(cut_up))


def combine(operation: Callable[..., DataFrame], a: DataFrame, b: DataFrame, item_pixels: DataFrame, level: int) -> DataFrame:
    """A set operation of ``cqr`` on the pieces that the leaves of both sides make, compacted. Leaves are at ``level`` or above, items' pixels there or below."""
    p = F.col("cell_id")
    a, b = cut(a), cut(b)  # each is read several times
    into = cut(pieces(a.select("cell_id").union(b.select("cell_id")).distinct(), level).select("cell_id", F.explode(ancestors(p, level)).alias("up")))
    own = item_pixels.select("item_id", F.explode(ancestors(ancestor(p, level), level)).alias("cell_id"))
    owners = cut(own.join(into.where("up = cell_id").select("cell_id"), "cell_id", "left_semi").select("item_id", "cell_id"))
    x, y = cut(split(a, into, owners)), cut(split(b, into, owners))
    return compactified(cut(operation(x, y) if operation is cqr.intersect else operation(x, y, owners)), level)


#: Grids by name: the pixel of a point.
GRIDS: dict[str, Callable[[Column, Column, int], Column]] = {"simplegrid": pixel}
