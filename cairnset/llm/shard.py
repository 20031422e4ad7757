"""Sharding by minimax contiguous partition.

Groups (equal texts) are atomic and ordered by a 64-bit hash of the text. The smallest feasible shard
capacity is binary-searched with a greedy check, and shards are cut there. The driver never holds the
groups: it holds sums over hash ranges, at most ``ROOM`` at a time, and asks for finer ranges only where
a cut can fall, until those ranges hold single groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Written

#: Ranges asked for at once.
ROOM = 1 << 16
#: Rows that a slot-numbering window holds at about most.
CELL = 1 << 18


@dataclass
class Range:
    lo: int  # smallest hash in it
    size: int
    largest: int
    groups: int
    bits: int  # leading bits that all its hashes share


def fill(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy check: where each shard starts if filled as far as ``capacity`` allows; None if ``shards`` are too few."""
    starts, room = [0], capacity
    for i, s in enumerate(sizes):
        if s > capacity:
            return None
        if s > room:
            starts.append(i)
            room = capacity
            if len(starts) > shards:
                return None
        room -= s
    return starts


def least_capacity(sizes: list[int], shards: int) -> int:
    """Binary search of the smallest capacity for which the greedy check succeeds."""
    lo, hi = max([-(-sum(sizes) // shards), *sizes, 0]), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        if fill(sizes, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def cuts(sizes: list[int], shards: int) -> tuple[list[int], int]:
    """Starts of the shards after the first and the minimax capacity. Within the capacity each shard takes
    about its share of what is left, so that one atomic giant doesn't empty the shards after it."""
    capacity = least_capacity(sizes, shards)
    # latest[k]: the first item from which k shards suffice
    latest, at = [len(sizes)], len(sizes)
    for _ in range(shards):
        room = capacity
        while at and sizes[at - 1] <= room:
            at -= 1
            room -= sizes[at]
        latest.append(at)
    starts, at, left = [], 0, sum(sizes)
    for k in range(shards - 1, 0, -1):
        aim, took, i = left / (k + 1), 0, at
        while i < len(sizes) and took + sizes[i] <= capacity and (i < latest[k] or abs(took + sizes[i] - aim) <= abs(took - aim)):
            took += sizes[i]
            i += 1
        starts.append(i)
        at, left = i, left - took
    return starts, capacity


def _ranges(groups: DataFrame, bits: int, within: list[tuple[int, int]] | None = None) -> list[Range]:
    """Sums over ranges of ``h`` with equal leading ``bits``; ``within``: only these (prefix, bits) ranges."""
    keep = groups if within is None else groups.where(F.shiftright("h", 64 - within[0][1]).isin([p for p, _ in within]))
    cell = F.shiftright("h", 64 - bits) if bits < 64 else F.col("h")
    rows = keep.groupBy(cell.alias("p")).agg(F.min("h").alias("lo"), F.sum("size").alias("s"), F.max("size").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((Range(r.lo, int(r.s), int(r.m), r.n, bits) for r in rows), key=lambda x: x.lo)


def minimax(groups: DataFrame, shards: int, room: int = ROOM) -> list[int]:
    """Hashes at which shards 1, 2, ... begin; exact for ``groups`` (``h, size``; distinct ``h``)."""
    bits = max(1, room.bit_length() - 1)
    ranges = _ranges(groups, bits)
    while True:
        sizes = [r.size for r in ranges]
        total, largest = sum(sizes), max([r.largest for r in ranges], default=0)
        low, high = max(-(-total // shards), largest), least_capacity(sizes, shards)
        # a cut k lies between the greedy one over whole ranges at the low capacity and k times the high one
        ends, below = [], 0
        for s in sizes:
            ends.append(below := below + s)
        floor, spans, at = 0, [], 0
        for k in range(1, shards):
            spans.append((floor := max([floor, *_up_to(ends, floor + low)]), min(total, k * high)))
        coarse = [i for i, r in enumerate(ranges) if r.groups > 1 and any(ends[i] > lo and ends[i] - r.size < hi for lo, hi in spans)]
        if not coarse or high == low:
            return _hashes(ranges, shards)
        # the ranges of fewest leading bits first, as many as there is room for
        step = min(ranges[i].bits for i in coarse)
        some = [i for i in coarse if ranges[i].bits == step]
        more = max(1, min(64 - step, (room // max(1, len(some))).bit_length() - 1))
        fine = _ranges(groups, step + more, [(ranges[i].lo >> (64 - step), step) for i in some])
        chosen = set(some)
        ranges = sorted([r for i, r in enumerate(ranges) if i not in chosen] + fine, key=lambda x: x.lo)


def _up_to(ends: list[int], most: int) -> list[int]:
    from bisect import bisect_right

    i = bisect_right(ends, most)
    return ends[i - 1 : i] if i else []


def _hashes(ranges: list[Range], shards: int) -> list[int]:
    starts, _ = cuts([r.size for r in ranges], shards)
    return [ranges[i].lo if i < len(ranges) else None for i in starts]


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, cell: int = CELL) -> DataFrame:
    """Every row of ``docs`` with its shard: ``doc_id, size`` (UTF-8 bytes plus 1), ``text_crc32, law`` (`bytes`),
    ``shard, slot`` (gapless from 0 in the shard), ``grown_shard`` (null: the law isn't by key).

    Equal texts stay in one shard. A null text counts as empty bytes, in a group of its own. Null and repeated ids are rows
    like any other. Only ids, sizes and hashes are shuffled, never texts; a hot group is summed before the shuffle, and slots
    are numbered in cells of rows dealt by a hash of id and position-free columns, not one window per shard.
    """
    spark, tables = docs.sparkSession, Written(docs.sparkSession)
    text = F.col(text_col).cast("string")
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text, text.isNull()).alias("h"),
    )
    slim = tables.cut(slim, "rows")
    groups = tables.cut(slim.groupBy("h").agg(F.sum("size").alias("size")), "groups")
    starts = minimax(groups, shards, room)
    shard = F.lit(0)
    for at in starts:
        if at is not None:
            shard = shard + (F.col("h") >= F.lit(at)).cast("int")
    n = slim.count()
    cells = max(1, -(-n // (cell * shards)) * 4)
    rows = slim.select("*", shard.alias("shard"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(cells)).cast("int").alias("cell"))
    counts = rows.groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "cell").orderBy("h", "doc_id")
    return (
        rows.withColumn("row", F.row_number().over(own))
        .join(offsets, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
