"""SimHash near-duplicate detection with pigeonring filtering.

A fingerprint has 64 bits. Two link if they differ in at most ``K`` bits. Cut the ring of bits into
``K + 1`` segments: of any linked pair some start segment has the property that the first 1, 2, 3, ...
segments from it differ in no more bits than their share of the budget (strong pigeonring). So the
start segment is equal, which is the join key, and the other chains prune before the full check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, components, numbered

K, SEGMENT = 3, 16
#: Rows that one task compares with each other at once; larger buckets are cut finer by the same rule.
BUCKET = 4096
_CHUNK = 1 << 17
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = np.arange(8, dtype=np.int64) * 256
_ALL = (1 << 64) - 1


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of ``text``'s word shingles (XXH64, unsigned); 0 without a word."""
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    if len(w) < words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    shingles = map(b" ".join, zip(*(islice(w, i, None) for i in range(words)), strict=False))
    return _majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(w) - words + 1))


def _majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n = len(h)
    if not n:
        return 0
    at = (h.view(np.uint8).reshape(n, 8) + _PLACE).ravel()
    ones = np.einsum("kb,bj->kj", np.bincount(at, minlength=2048).reshape(8, 256), _BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's 64 bits as a long) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py() or b"", words, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def segments(k: int = K) -> list[int]:
    """The bit masks of ``k + 1`` ring segments of about equal length."""
    return _split(0, k + 1)


def _split(fixed: int, parts: int) -> list[int]:
    free = [i for i in range(64) if not fixed >> i & 1]
    cut = [len(free) * p // parts for p in range(parts + 1)]
    return [m for p in range(parts) if (m := sum(1 << i for i in free[cut[p] : cut[p + 1]]))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_runs(bucket: np.ndarray, fp: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that connect what is linked inside each run of equal ``bucket``: a forest, not all pairs."""
    seg = segments(k)
    ring = np.array([[sum(seg[(s + j) % (k + 1)] for j in range(n + 1)) for n in range(k + 1)] for s in range(k + 1)], np.uint64)
    n = len(fp)
    ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, n)
    end = np.repeat(ends, np.diff(np.append(0, ends)))
    label = np.arange(n)
    at, step = np.arange(n), 0
    while True:
        step += 1
        at = at[at + step < end[at]]
        if not len(at):
            break
        i = at[label[at] != label[at + step]]
        x = fp[i] ^ fp[i + step]
        for chain in range(1, k + 1):  # the start segment is equal: it is in the key
            fits = np.bitwise_count(x & ring[start[i], chain]) <= (chain + 1) * k // (k + 1)
            i, x = i[fits], x[fits]
        j = i + step
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def links(classes: DataFrame, tables: Written, k: int = K, bucket: int = BUCKET) -> DataFrame:
    """Links ``a, b`` between the ``node``s of ``classes`` (``node, fp``, each ``fp`` once: equal ones can't be cut apart) that connect all
    pairs within ``k`` bits. A bucket of over ``bucket`` rows is cut by the pigeonhole rule on the bits that
    its key leaves free, again and again; so no task holds a large bucket and no link is lost."""
    first = [_signed(m) for m in segments(k)]

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = batch.column(3).to_numpy()
            for m in np.unique(mask):
                rows = batch.filter(pa.array(mask == m))
                for part in _split(int(m) & _ALL, k + 1):
                    new = pa.array(np.full(rows.num_rows, _signed(int(m) & _ALL | part), np.int64))
                    yield pa.RecordBatch.from_arrays([*rows.columns[:3], new], names=["node", "fp", "start", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch:
            node, fp, start, mask, key = (t.column(c).to_numpy() for c in ("node", "fp", "start", "mask", "key"))
            new = np.append(True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))
            i, j = link_runs(np.cumsum(new), fp.view(np.uint64), start, k)
            return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < _CHUNK:
                continue
            t = pa.Table.from_batches(held)
            mask, key = t.column("mask").to_numpy(), t.column("key").to_numpy()
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))
            if not len(cut):
                continue
            yield done(t.slice(0, cut[-1] + 1))
            held = t.slice(cut[-1] + 1).to_batches()
            size = sum(x.num_rows for x in held)
        if size:
            yield done(pa.Table.from_batches(held))

    todo = classes.select("node", "fp", F.posexplode(F.array(*[F.lit(m) for m in first])).alias("start", "mask"))
    found, level = None, 0
    while True:
        rows = todo.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        large = tables.cut(rows.groupBy("mask", "key").count().where(F.col("count") > bucket).drop("count"), f"large-{level}")
        again = not large.isEmpty()
        if again:
            rows = tables.cut(rows, f"rows-{level}")
        small = rows.join(large, ["mask", "key"], "left_anti") if again else rows
        part = small.repartition("mask", "key").sortWithinPartitions("mask", "key").select("node", "fp", "start", "mask", "key").mapInArrow(run, "a long, b long")
        found = part if found is None else found.union(part)
        if not again:
            return found
        todo = rows.join(large, ["mask", "key"], "left_semi").select("node", "fp", "start", "mask").mapInArrow(finer, "node long, fp long, start int, mask long")
        level += 1


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, k: int = K, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest id
    reachable over links of at most ``k`` bits), ``fp``.

    Null and empty texts have no words and the fingerprint zero, linked like any other. Rows with a null id
    get their fingerprint and a null component. Repeated ids give a row each; the component takes
    whatever any of them reaches. Other columns of ``docs`` aren't read. Exact copies collapse
    before the search: only distinct fingerprints are compared.
    """
    tables = Written(docs.sparkSession)
    slim = tables.cut(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    known = slim.where("doc_id is not null")
    classes = tables.cut(known.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    found = links(classes, tables, k, bucket)
    # an id that occurs with several texts joins their classes
    several = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("doc_id")
    also = known.join(several, "doc_id", "left_semi").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    roots = components(found.union(also), tables)
    named = classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    out = slim.join(named, "fp", "left")
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        "fp",
    )


#: Bins of a text's shingles, and the bins in a key: of two texts of Jaccard similarity 0.8 all but 1 in 10,000 share one of the 25 keys.
BINS, BAND = 125, 5
#: Rounds of hubs for keys that more than a bucket of groups share.
ROUNDS = 3


def shingles(text: bytes, words: int, seed: int) -> tuple[int, int, np.ndarray]:
    """Hash of a text's words, its SimHash, and the hashes of its distinct ``words``-word shingles in order; none without a word."""
    import xxhash

    w = text.lower().split()
    n = len(w) - words + 1
    parts = map(b" ".join, zip(*(islice(w, i, None) for i in range(words)), strict=False)) if n > 0 else [b" ".join(w)] if w else []
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64)
    return xxhash.xxh64_intdigest(b" ".join(w), seed), _majority(h), np.unique(h)


def keys(h: np.ndarray) -> list[int]:
    """A hash for each ``BAND`` bins of shingles, of the least in each bin; bands without any are left out."""
    import xxhash

    place = (h % np.uint64(BINS)).astype(np.int64)
    bins, first = np.unique(place, return_index=True)
    least = np.zeros(BINS, np.uint64)
    least[bins] = h[first]
    rows = least.reshape(-1, BAND)
    return [_signed(xxhash.xxh64_intdigest(rows[b].tobytes(), int(b))) for b in np.flatnonzero(rows.any(1))]


def _judge(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (``a, b``) whose shingle ``sets`` (``own, s``) have the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v.as_py(), np.uint64) for v in batch.column(c)] for c in (2, 3))
            same = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
            whole = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)], np.int64) - same
            yield batch.select([0, 1]).filter(pa.array(same >= similarity * whole - 1e-9))

    a, b = (sets.select(F.col("own").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def near_texts(docs: DataFrame, tables: Written, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, version, root`` of every row: groups of texts whose ``words``-word shingles have a Jaccard similarity of
    ``similarity`` or more; ``version`` is the text's hash, and a group has one ``root``.

    Candidates are texts whose SimHashes of shingles differ in at most ``K`` bits (by pigeonring), and, as block edits scatter a SimHash, texts that share a key of their least shingles;
    the similarity is exact. A key's texts meet its least first, then, if more than ``bucket`` groups share it, further hubs; then all pairs in different groups,
    so no link is missed and a group of n copies doesn't make n^2 pairs. Texts without a word, null ones among them, are one group.
    """

    def each(batch: pa.RecordBatch) -> tuple:
        got = [shingles(t.as_py() or b"", words, seed) for t in batch.column(batch.num_columns - 1)]
        own, fp = (pa.array(np.array([g[k] for g in got], np.uint64).view(np.int64)) for k in (0, 1))
        return own, fp, [g[2] for g in got]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, fp, sets = each(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own, fp, pa.array([len(h) for h in sets], pa.int64()), pa.array([keys(h) for h in sets], pa.list_(pa.int64()))], names=["doc_id", "version", "own", "fp", "n", "keys"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, _, sets = each(batch)
            yield pa.RecordBatch.from_arrays([own, pa.array([h.tobytes() for h in sets], pa.binary())], names=["own", "s"])

    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).cast("string").cast("binary").alias("t"))
    slim = tables.cut(raw.mapInArrow(run, "doc_id long, version long, own long, fp long, n long, keys array<long>"), "views")
    classes = tables.cut(slim.groupBy("own").agg(F.min("version").alias("version"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    # texts of one SimHash meet the least of them; of that each has links within K bits
    alone = classes.groupBy("fp").agg(F.min("own").alias("node"))
    linked = links(alone.select("node", "fp"), tables, bucket=bucket)
    same = classes.join(alone, "fp").where(F.col("own") != F.col("node")).select(F.col("own").alias("a"), F.col("node").alias("b"))
    linked = tables.cut(linked.union(same), "linked")
    rows = classes.select("own", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key")
    rows = tables.cut(rows.join(shared, "key").select("own", "n", "key"), "keys")
    near = F.least("a.n", "b.n") >= F.lit(similarity) * F.greatest("a.n", "b.n")
    # the shingles of texts that may have copies
    met = rows.select("own").union(linked.select("a")).union(linked.select("b")).distinct()
    wanted = classes.join(met, "own", "left_semi").select("version").distinct()
    sets = tables.cut(raw.join(wanted, "version", "left_semi").select("t").mapInArrow(again, "own long, s binary").dropDuplicates(["own"]), "sets")
    edges = _judge(linked, sets, similarity)
    grouped = rows.withColumn("group", F.col("own"))
    for k in range(ROUNDS + 1):
        met = grouped
        if k:
            crowded = tables.cut(grouped.groupBy("key").agg(F.countDistinct("group").alias("groups")).where(F.col("groups") > bucket).select("key"), f"crowded-{k}")
            if crowded.isEmpty():
                break
            met = grouped.join(crowded, "key", "left_semi")
        hubs = met.groupBy("key").agg(F.min(F.struct(F.xxhash64("own", F.lit(k)), "own", "n", "group")).alias("h")).select("key", "h.own", "h.n", "h.group")
        pairs = met.alias("a").join(hubs.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.group") != F.col("b.group")) & near)
        edges = tables.cut(edges.union(_judge(pairs.select(F.col("a.own").alias("a"), F.col("b.own").alias("b")).distinct(), sets, similarity)), f"edges-{k}")
        roots = components(edges, tables, f"hubs-{k}")
        grouped = tables.cut(rows.join(roots, F.col("own") == F.col("node"), "left").select("own", "n", "key", F.coalesce("root", "own").alias("group")), f"grouped-{k}")
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.own") < F.col("b.own")) & (F.col("a.group") != F.col("b.group")) & near
    pairs = grouped.alias("a").join(grouped.alias("b"), apart).select(F.col("a.own").alias("a"), F.col("b.own").alias("b")).distinct()
    roots = components(edges.union(_judge(pairs, sets, similarity)), tables)
    named = classes.join(roots.toDF("other", "root"), F.col("own") == F.col("other"), "left").select("own", F.coalesce("root", "own").alias("root"))
    return tables.cut(slim.select("doc_id", "version", "own").join(named, "own").select("doc_id", "version", "root"), "near-texts")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``doc_id, component_id`` of every row with an id: the smallest id in the groups of ``near_texts``; repeated ids join what any of their rows reaches."""
    tables = Written(docs.sparkSession)
    named = near_texts(docs, tables, id_col, text_col, **how).where("doc_id is not null")
    least = tables.cut(named.groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    roots = components(named.join(least, "root").select("doc_id", "least"), tables, "ids")
    return named.select("doc_id").join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of ``docs`` of each group of ``near_texts``: that of the smallest id (null last), then of the smallest hash of the text; of rows alike in id and text one.

    Columns stay, whatever their names. Null, empty and blank texts are one group. An empty table gives an empty one; texts are compared whole.
    """
    tables = Written(docs.sparkSession)
    named = near_texts(docs, tables, id_col, text_col, **how)
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "version")
    firsts = named.groupBy("root").agg(F.min(place).alias("first")).select("first.doc_id", "first.version")
    counts = named.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("times"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.version") == F.col("b.version"))
    stay = tables.cut(counts.alias("a").join(firsts.alias("b"), same, "left_semi"), "stay")
    for name in ("views", "classes", "linked", "keys", "sets", "near-texts"):
        tables.drop(name)
    rows, of = numbered(docs)
    rows = rows.join(stay, F.col(of[id_col]).cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(of[text_col]) == F.col("version")))
    several = rows.where("times > 1").groupBy("doc_id", "version").agg(F.first(F.struct(*of.values())).alias("row")).select("row.*")
    return rows.where("times = 1").select(*of.values()).union(several).toDF(*of)
