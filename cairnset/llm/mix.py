"""Mixing sources to target weights by Sainte-Laguë apportionment.

The tokens that the mix takes are dealt out in equal blocks. Sources get whole blocks by highest
quotients ``target / (2 s + 1)``, a source's blocks go to its shards in the same way by their tokens, what is left of a block is settled in the shards, and a
shard takes its quota from its seeded stream of documents: whole passes, then seeded blocks.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Written, numbered

#: Words of a block, about how many a shard of a source holds, and how many rows.
BLOCK, SHARD, ROWS = 64, 1 << 22, 1 << 14
#: Blocks of a shard at least, if it has as many words: a small shard's are shorter.
LEAST = 16


def sainte_lague(weights: list[float], seats: int, most: list[int]) -> list[int]:
    """``seats`` by highest quotients ``w / (2 s + 1)``, none above its ``most``; ties to the earlier.

    Same result as awarding seat after seat: a divisor that awards at most ``seats`` is bisected,
    the few seats that are left go one by one.
    """
    seats = min(seats, sum(m for w, m in zip(weights, most, strict=True) if w > 0))

    def award(d: float) -> list[int]:
        return [min(m, max(0, math.floor(w / d + 0.5))) if w > 0 else 0 for w, m in zip(weights, most, strict=True)]

    if seats <= 0:
        return [0] * len(weights)
    lo, hi = 0.0, 4.0 * max(weights)
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid <= 0 or mid in (lo, hi):
            break
        if sum(award(mid)) <= seats:
            hi = mid
        else:
            lo = mid
    got = award(hi)
    while (left := seats - sum(got)) > 0:
        best = max((i for i in range(len(weights)) if got[i] < most[i] and weights[i] > 0), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[best] += 1
        del left
    return got


def _ranked(sizes: DataFrame, tables: Written) -> DataFrame:
    """``sizes`` with ``rank``, the row's number by ``source`` in code point order, null last: sorted in ranges, that are counted."""
    rows = tables.cut(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("range", F.shiftright("at", 33))
    before, offsets = 0, []
    for r in rows.groupBy("range").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n")).orderBy("range").collect():  # a row for each partition
        offsets.append((r["range"], before - r.lo))
        before += r.n
    offsets = sizes.sparkSession.createDataFrame(offsets, "range long, offset long")
    return rows.join(offsets, "range").withColumn("rank", F.col("at") + F.col("offset")).drop("at", "range", "offset")


def source_targets(sizes: DataFrame, tables: Written, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: float = 2.0) -> DataFrame:
    """``sizes`` (``source, source_size``) with ``weight`` and ``target``: ``share`` of all sizes split by weight,
    no target above ``most`` times its source's size; what is above is reshared by weight until none is.

    Of any number of sources only sums reach the driver, once for each resharing.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = _ranked(sizes, tables).select("source", "source_size", w.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    rows = tables.cut(rows, "weighed")
    level, full, last = 0.0, F.lit(False), -1
    while True:
        free = ~full
        r = rows.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(free, F.col("weight"))), F.count(F.when(full, 1))).first()
        if r[3] == last or not r[2]:
            return rows.select("source", "source_size", "weight", F.when(full, F.col("cap")).otherwise(F.least("cap", F.lit(level) * F.col("weight"))).alias("target"))
        last = r[3]
        level = (r[0] * share - (r[1] or 0.0)) / r[2]
        full = F.lit(level) * F.col("weight") >= F.col("cap")


def chosen(block: Column) -> Column:
    """Seeded blocks before ``block`` of a shard: ``rest`` of its ``blocks``, spread evenly from a seeded ``turn``."""
    return F.floor((block * F.col("rest") + F.col("turn")) / F.col("blocks")).cast("long")


def covered(position: Column) -> Column:
    """Words before ``position`` of a shard's stream that its seeded blocks (``length`` words each, the last shorter) cover."""
    x = F.floor(position / F.col("length")).cast("long")
    return chosen(x) * F.col("length") + (chosen(x + 1) - chosen(x)) * (position - x * F.col("length"))


def _quota(target: Column, size: Column, block: int) -> Column:
    """Whole blocks of a source. Highest quotients with as many seats as blocks fit by rounding: the last seat's quotient is then that of one block,
    so each source has its target over the block, rounded, and no source waits for another."""
    return F.least(F.floor(target / block + F.lit(0.5)), 2 * F.ceil(size / block)).cast("long")


def _over_shards(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("shard")
    block, quota, t = int(frame["block"].iloc[0]), int(frame["quota"].iloc[0]), [int(x) for x in frame["t"]]
    n = [max(1, round(x / block), min(x, LEAST)) for x in t]
    length = [max(1, -(-x // k)) for x, k in zip(t, n, strict=True)]
    n = [max(1, -(-x // k)) for x, k in zip(t, length, strict=True)]
    got = sainte_lague([float(x) for x in t], quota, [2 * -(-x // block) for x in t])
    # a shard's blocks aren't of ``block`` words, nor is the target: what rounding leaves goes on to the next shard, and at the end round again
    due, took = float(frame["target"].iloc[0]) - quota * block, [0] * len(t)
    for more in (got, [0] * len(t)):
        for i, (k, g, x) in enumerate(zip(n, more, t, strict=True)):
            due += g * block
            if x:
                add = min(2 * k - took[i], max(-took[i], round(due * k / x)))
                took[i] += add
                due -= add * x / k
    return frame.assign(length=length, blocks=n, passes=[g // k for g, k in zip(took, n, strict=True)], rest=[g % k for g, k in zip(took, n, strict=True)])


def _sized(docs: DataFrame, keep: list[Column], seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``keep`` and ``source, size, order``: the rows in a seeded order by id and text."""
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*keep, F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(id_col).cast("long"), text, F.lit(seed)).alias("order"))


def positions(sized: DataFrame, tables: Written, share: float, weights: tuple[int, ...], most: float, block: int, shard_words: int, seed: int) -> DataFrame:
    """``sized`` (``source, size, order`` and others) with each row's place ``[start, start + size)`` in its shard's stream and what the shard takes.
    Rows without a word have no place: they take nothing."""
    keep = [c for c in sized.columns if c != "order"]
    counts = tables.cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.greatest(F.lit(1), F.ceil(F.sum("size") / F.lit(shard_words)), F.ceil(F.count(F.lit(1)) / F.lit(ROWS))).alias("shards")), "shards")
    targets = source_targets(counts.select("source", "source_size"), tables, share, weights, most).withColumn("block", F.lit(block))
    quotas = tables.cut(targets.withColumn("quota", _quota(F.col("target"), F.col("source_size"), block)), "sources")
    both = F.col("p.source").eqNullSafe(F.col("q.source"))
    shard = F.pmod(F.xxhash64("order", "size"), F.col("q.shards")).cast("int").alias("shard")
    dealt = sized.where("size > 0").alias("p").join(counts.alias("q"), both).select("p.*", shard)
    cells = dealt.groupBy("source", "shard").agg(F.sum("size").alias("t"))
    plan = cells.alias("p").join(quotas.alias("q"), both).select("p.source", "p.shard", "p.t", "q.target", "q.block", "q.quota")
    plan = plan.groupBy("source").applyInPandas(_over_shards, "source string, shard int, t long, target double, block int, quota long, length long, blocks long, passes long, rest long")
    plan = tables.cut(plan.withColumn("turn", F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.col("blocks"))), "plan")
    stream = Window.partitionBy("source", "shard").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("start", F.sum("size").over(stream) - F.col("size"))
    out = placed.alias("p").join(plan.alias("q"), both & (F.col("p.shard") == F.col("q.shard"))).select(*[f"p.{c}" for c in keep], "p.start", "q.length", "q.blocks", "q.passes", "q.rest", "q.turn")
    long = lambda c: F.lit(None).cast("long").alias(c)
    empty = sized.where("size = 0").select(*keep, *map(long, ("start", "length", "blocks", "passes", "rest", "turn")))
    return out.union(empty).alias("p").join(quotas.alias("q"), both).select("p.*", "q.source_size", "q.target")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: float = 2.0, block: int = BLOCK, shard_words: int = SHARD, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, taken`` and the place of the
    row's words (``start``, ``length``, ``blocks``, ``passes``, ``rest``, ``turn``), from which ``mixed_texts`` cuts them.

    Sources in code point order, a null source last and one of its own; they weigh ``weights``, repeating. A null or empty text
    has size 0 and takes 0 (its place is null); so has the mix of an empty table. Null and repeated ids are rows like any other;
    rows alike in id, text and source are interchangeable. A source is dealt over its own shards of about ``shard_words`` words, ``ROWS`` rows at most or so, by
    a hash of the row's id and text; only ids and sizes are shuffled. Other columns, whatever their names, aren't read.
    """
    tables = Written(docs.sparkSession)
    sized = tables.cut(_sized(docs, [F.col(id_col).cast("long").alias("doc_id")], seed, id_col, text_col, source_col), "rows")
    rows = positions(sized, tables, share, weights, most, block, shard_words, seed)
    end = F.col("start") + F.col("size")
    taken = F.coalesce(F.col("passes") * F.col("size") + covered(end) - covered(F.col("start")), F.lit(0).cast("long"))
    return rows.withColumn("taken", taken)


def mixed_texts(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: float = 2.0, block: int = BLOCK, shard_words: int = SHARD, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, with the columns of ``docs``, whatever their names: a row for every whole pass over a document, and one more
    whose text is the words in its shard's seeded blocks, with the white space after them; ``n_chars``, if there is one, is set anew.

    Rows without a word go once as they are. Null and repeated ids, and repeated rows, are rows like any other: the texts go through the plan's shuffle themselves.
    """
    tables = Written(docs.sparkSession)
    rows, of = numbered(docs)
    text = F.col(of[text_col])
    sized = _sized(rows, [F.col(k) for k in of.values()], seed, of[id_col], of[text_col], of[source_col])
    rows = positions(sized, tables, share, weights, most, block, shard_words, seed)
    words = F.regexp_extract_all(text, F.lit("([\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*)"), F.lit(1))
    at = lambda i: F.floor((F.col("start") + i) / F.col("length")).cast("long")
    part = F.array_join(F.filter(words, lambda w, i: chosen(at(i) + 1) > chosen(at(i))), "")
    some = covered(F.col("start") + F.col("size")) - covered(F.col("start"))
    once = F.when(some <= 0, F.array().cast("array<string>")).when(some >= F.col("size"), F.array(text)).otherwise(F.array(part))
    copies = F.when(F.col("size") == 0, F.array(text)).otherwise(F.concat(F.array_repeat(text, F.col("passes").cast("int")), once))
    rows = rows.select(*of.values(), F.explode(copies).alias("text"))
    own = {text_col: F.col("text").cast(docs.schema[text_col].dataType)}
    if "n_chars" in of:
        own["n_chars"] = F.when(F.col("text").isNull(), F.col(of["n_chars"])).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[own.get(c, F.col(k)).alias(c) for c, k in of.items()])
