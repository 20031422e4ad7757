"""Region DAGs: ``child, parent`` edges, ``cell_id, region_id`` closure, roll-ups of cell query results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut
from . import cqr, graph


def ancestors(parents: DataFrame, levels: int = 64) -> DataFrame:
    """``node, ancestor, depth`` (longest path), a join a level until nothing is new; every level is written to the shared folder."""
    edges = cut(parents.select("child", "parent").distinct())
    step = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    found = step
    for level in range(2, levels + 1):
        step = cut(step.join(edges, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor")).distinct().withColumn("depth", F.lit(level)))
        if step.isEmpty():
            return found.groupBy("node", "ancestor").agg(F.max("depth").alias("depth"))
        found = found.union(step)
    raise ValueError("the hierarchy is deeper than allowed, or has a cycle")


def paths(parents: DataFrame, root: int, levels: int = 64) -> DataFrame:
    """``region_id, times``: how often a walk from the root, once a path, comes by."""
    edges = cut(parents.select("child", "parent").distinct())
    step = edges.where(F.col("parent") == root).select(F.col("child").alias("region_id"), F.lit(1).cast("long").alias("times"))
    found = edges.sparkSession.range(1).select(F.lit(root).cast("long").alias("region_id"), F.lit(1).cast("long").alias("times")).union(step)
    for _ in range(levels):
        step = cut(step.join(edges, F.col("region_id") == F.col("parent")).groupBy(F.col("child").alias("region_id")).agg(F.sum("times").alias("times")))
        if step.isEmpty():
            return found.groupBy("region_id").agg(F.sum("times").alias("times"))
        found = found.union(step)
    raise ValueError("the hierarchy is deeper than allowed, or has a cycle")


def without_parent(regions: DataFrame, parents: DataFrame) -> DataFrame:
    return regions.join(parents, F.col("region_id") == F.col("child"), "left_anti")


def direct_cell_parents(cell_parents: DataFrame, closure: DataFrame) -> DataFrame:
    """Parents of a cell that aren't ancestors of another of its parents."""
    a, b = cell_parents.alias("a"), cell_parents.alias("b")
    above = a.join(b, F.col("a.cell_id") == F.col("b.cell_id")).join(closure, (F.col("node") == F.col("b.region_id")) & (F.col("ancestor") == F.col("a.region_id")))
    return cell_parents.join(above.select("a.cell_id", "a.region_id").distinct(), ["cell_id", "region_id"], "left_anti")


def sub_set(result: DataFrame, universe: DataFrame, cell_parents: DataFrame) -> DataFrame:
    """``region_id, n_cells, max_items``: facets of a result; an item in several cells counts in each (an upper bound)."""
    per_cell = cqr.sizes(result, universe).select("cell_id", "n")
    return per_cell.join(cell_parents, "cell_id").groupBy("region_id").agg(F.count("cell_id").alias("n_cells"), F.sum("n").alias("max_items"))


def region_items(cell_parents: DataFrame, universe: DataFrame) -> DataFrame:
    return cell_parents.join(universe, "cell_id").select("region_id", "item_id").distinct()


def exclusive_cells(cell_parents: DataFrame, parents: DataFrame) -> DataFrame:
    """Cells of a region that no child of it holds."""
    of_children = parents.join(cell_parents, F.col("child") == F.col("region_id")).select(F.col("parent").alias("region_id"), "cell_id").distinct()
    return cell_parents.join(of_children, ["region_id", "cell_id"], "left_anti")


def neighbours(cell_parents: DataFrame, edges: DataFrame) -> DataFrame:
    """``region_id, neighbour``: regions of bordering cells that share no cell with the region."""
    a, b = cell_parents.toDF("c1", "region_id"), cell_parents.toDF("c2", "neighbour")
    near = a.join(edges, F.col("c1") == F.col("src")).join(b, F.col("dst") == F.col("c2")).select("region_id", "neighbour").distinct()
    overlap = a.join(b, F.col("c1") == F.col("c2")).select("region_id", "neighbour").distinct()
    return near.join(overlap, ["region_id", "neighbour"], "left_anti")


def path_to_branch(counts: DataFrame, parents: DataFrame, root: int, fraction: float = 0.95) -> list[int]:
    """From the root to the child with the most items while its share reaches ``fraction``; one small query a level."""
    path, node = [root], root
    have = sum(r.max_items for r in counts.where(F.col("region_id") == root).take(1))
    while have:
        best = parents.where(F.col("parent") == node).join(counts, F.col("child") == F.col("region_id")).orderBy(F.desc("max_items"), "child").take(1)
        if not best or best[0].max_items < fraction * have:
            break
        node, have = best[0].child, best[0].max_items
        path.append(node)
    return path


def cover(cell_parents: DataFrame, parents: DataFrame, root: int, levels: int = 64) -> DataFrame:
    """``node, is_cell, parent, depth``: the DAG as a tree. Of a region's children those are taken, smallest first and then by id, that overlap none
    taken before; cells of the region in none of them hang directly below it.

    A level at a time: within a region, a child is taken in round k if it is the first of the children left that overlap no taken one. Rounds
    run for all regions of a level at once; children of one region are compared by their cells.
    """
    closure = cut(cell_parents.distinct())
    sizes = cut(closure.groupBy("region_id").agg(F.count("cell_id").alias("n")))
    edges = cut(parents.distinct())
    level = closure.sparkSession.range(1).select(F.lit(root).cast("long").alias("region_id"))
    out = level.select(F.col("region_id").alias("node"), F.lit(False).alias("is_cell"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"))
    for depth in range(1, levels + 1):
        left = cut(level.join(edges, F.col("region_id") == F.col("parent")).select("parent", "child").join(sizes, F.col("child") == F.col("region_id")).select("parent", "child", "n"))
        taken = left.where("false")
        while not left.isEmpty():
            best = cut(left.groupBy("parent").agg(F.min(F.struct("n", "child")).alias("b")).select("parent", F.col("b.child").alias("child"), F.col("b.n").alias("n")))
            taken = cut(taken.union(best))
            held = best.join(closure, F.col("child") == F.col("region_id")).select("parent", "cell_id")
            clash = left.join(closure, F.col("child") == F.col("region_id")).join(held, ["parent", "cell_id"], "left_semi").select("parent", "child").distinct()
            left = cut(left.join(clash, ["parent", "child"], "left_anti"))
        mine = level.join(closure, "region_id").select(F.col("region_id").alias("parent"), "cell_id")
        held = taken.join(closure, F.col("child") == F.col("region_id")).select("parent", "cell_id")
        cells = mine.join(held, ["parent", "cell_id"], "left_anti")
        out = out.union(taken.select("child", F.lit(False), "parent", F.lit(depth))).union(cells.select("cell_id", F.lit(True), "parent", F.lit(depth)))
        level = cut(taken.select(F.col("child").alias("region_id")))
        if level.isEmpty():
            return out
    raise ValueError("the hierarchy is deeper than allowed, or has a cycle")


def dilate(base: DataFrame, edges: DataFrame, distances: DataFrame, metres: float) -> DataFrame:
    """Cells reached from a base cell over cells that aren't base and whose centre is within ``metres`` of that base cell."""
    base = base.select("cell_id").distinct()
    mine = distances.join(base.select(F.col("cell_id").alias("src")), "src", "left_semi").where(F.col("distance") < metres)
    allowed = cut(mine.select(F.col("src").alias("origin"), F.col("dst").alias("cell_id")).join(base, "cell_id", "left_anti"))
    seen = graph.spread(base.select(F.col("cell_id").alias("origin"), "cell_id"), edges, allowed)
    return seen.join(base, "cell_id", "left_anti").select("cell_id").distinct()
