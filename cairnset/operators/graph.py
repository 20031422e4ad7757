"""Iterative operators on graphs: components, reachability. Every round is written to the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut


#: Links of a partition.
PART = 1 << 19


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows``, about ``n`` of them, in partitions of about ``PART``: what a task holds doesn't grow with the table, however many partitions the session has and however Spark would join them."""
    return rows.repartition(max(1, -(-n // PART)), *keys)


def with_least(links: DataFrame, key: str, edges: DataFrame, n: int) -> DataFrame:
    """``links`` with ``m``, the least ``v`` that ``edges`` (``u, v``) have for their ``key`` as ``u``, null without one. Minima, a row a node, are hashed and links stream by, so a hub's many links take no memory."""
    least = dealt(edges, n, "u").groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    return dealt(links, n, key).join(least.hint("shuffle_hash"), F.col(key) == F.col("node"), "left").drop("node")


def large_star(edges: DataFrame, n: int) -> DataFrame:
    """Of ``edges`` (``u > v``, ``n`` rows) each ``u`` with the least of ``v`` and its neighbours: ``v`` itself, unless it is some edge's ``u``."""
    return dealt(with_least(edges, "v", edges, n).select("u", F.coalesce("m", "v").alias("v")), n, "u", "v").distinct()


def small_star(edges: DataFrame, n: int) -> DataFrame:
    """Of ``edges`` (``u > v``, ``n`` rows at most) each ``u``, and each of its ``v``, with the least ``v``."""
    near = with_least(edges, "u", edges, n)
    return dealt(near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")), n, "u", "v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links`` (two columns), root the least of its component.

    Alternating large and small stars: the rounds grow with the logarithm of the nodes; no round makes more
    rows than there are links, and a task holds a bounded number of them.
    """
    a, b = links.columns
    n = links.count()
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = cut(dealt(edges, n, "u", "v").distinct())
    seal = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seal or not now[0]:
            break
        seal = now
        edges = cut(small_star(cut(large_star(edges, now[0])), now[0]))
    # each node but the roots now has one edge, to its root; others are alone
    alone = links.where(F.coalesce(F.col(a) == F.col(b), F.lit(True)))
    alone = alone.select(F.col(a).alias("node")).union(alone.select(b))
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v"))
    found = found.union(alone.select("node", F.lit(None).cast("long")))
    found = dealt(found, 2 * n, "node").groupBy("node").agg(F.min("root").alias("root"))
    return found.select("node", F.coalesce("root", "node").alias("root"))


def spread(start: DataFrame, edges: DataFrame, allowed: DataFrame, rounds: int = 1000) -> DataFrame:
    """``origin, cell_id`` reached from ``start`` (``origin, cell_id``) over ``edges`` (``src, dst``), each step onto an
    ``allowed`` (``origin, cell_id``) row.

    A round joins the frontier and writes what is new. Rounds stay tables of their own; as in a counter, sixteen of a size are merged to one of the next,
    so a row is written again a logarithm of the rounds times at most, and a plan reads few tables.
    """
    step = cut(start.select("origin", "cell_id").distinct())
    seen: list[list[DataFrame]] = [[step]]
    whole = lambda: reduce(DataFrame.union, [t for ts in seen for t in ts])
    for _ in range(rounds):
        new = step.join(edges, F.col("cell_id") == F.col("src")).select("origin", F.col("dst").alias("cell_id")).distinct()
        step = cut(new.join(allowed, ["origin", "cell_id"], "left_semi").join(whole(), ["origin", "cell_id"], "left_anti"))
        if step.isEmpty():
            return whole()
        seen[0].append(step)
        for k, tables in enumerate(seen):
            if len(tables) < 16:
                break
            if k + 1 == len(seen):
                seen.append([])
            seen[k + 1].append(cut(reduce(DataFrame.union, tables)))
            seen[k] = []
    raise ValueError("the frontier is still moving")
