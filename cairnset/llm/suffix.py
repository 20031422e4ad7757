"""Removal of repeated passages by a hash-compared suffix sort.

A window of ``WINDOW`` bytes that occurs twice holds the same anchor in both places: the ``GRAM`` bytes with
the smallest hash in it. Anchors whose hash occurs once in the corpus can't be in a repeated window and go; the others
carry their surroundings to the group of their hash. There the texts from the anchor on are sorted as suffixes:
merge sort whose comparisons find the common extension by binary search over prefix polynomial hashes, in a logarithm of
its length; neighbours' extensions are then verified byte by byte. To the left classes are refined exactly, a byte at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written

WINDOW, GRAM = 200, 50
#: Members of an anchor's group that one task sorts; windows of larger groups are counted one by one instead.
GROUP = 1 << 15
#: Bytes of surroundings that are sorted together.
ROOM = 1 << 22
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.multiply.accumulate(np.append(np.uint64(1), np.full(max(1 << 18, n + n // 4), b, np.uint64)))
    return _powers[0], _powers[1]


def prefixes(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes: the hash of ``data[i:i + n]`` is ``(p[i + n] - p[i]) * base ** i``."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _upto(len(data) + 1)[1][: len(data)], out=p[1:])
    return p


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``n`` neighbours, by doubling."""
    have = 1
    while have * 2 <= n:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (n - have)], x[n - have :]) if have < n else x


def anchors(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows: position, hash, first and last window start that it is the (leftmost) anchor of."""
    n, w = len(data), window - gram + 1
    if n < window:
        return (np.zeros(0, np.int64),) * 4
    p = prefixes(data)
    h = _mix((p[gram:] - p[:-gram]) * _upto(n + 1)[0][: n - gram + 1])
    least = _slide(h, w, np.minimum)
    first = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    last = np.append(first[1:], len(least)) - 1
    reach = _slide(np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    at = np.flatnonzero(reach == h)
    values, code = np.unique(h[at], return_inverse=True)
    key = code * (n + 1) + at
    order = np.argsort(key)
    at, key = at[order], key[order]
    run = np.searchsorted(values, least[first]) * (n + 1)
    lo, hi = np.searchsorted(key, run + first), np.searchsorted(key, run + last)
    # the last anchor of a run may stand after its last window start
    hi = np.where((hi < len(key)) & (key[np.minimum(hi, len(key) - 1)] <= run + np.minimum(last + w - 1, n)), hi, hi - 1)
    many = hi - lo + 1
    of = np.repeat(np.arange(len(first)), many)
    i = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + lo[of]
    pos = at[i]
    x0 = np.where(i == lo[of], first[of], at[np.maximum(i - 1, 0)] + 1)
    x1 = np.minimum(last[of], pos)
    good = x0 <= x1
    pos, x0, x1 = pos[good], x0[good], x1[good]
    return pos, h[pos], x0, x1


class Text:
    """Bytes with prefix hashes; suffixes may be compared up to a length of their own."""

    def __init__(self, data: np.ndarray):
        self.data, self.p = data, prefixes(data)
        self.power = _upto(len(data) + 1)[0]

    def hash(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.p[i + n] - self.p[i]) * self.power[i]

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes ``i`` and ``j``, ``most`` at most, by binary search."""
        lo, hi = np.zeros(len(i), np.int64), most.astype(np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.hash(i, mid) == self.hash(j, mid)
            lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray, ni: np.ndarray, nj: np.ndarray) -> np.ndarray:
        """Is suffix ``i`` (``ni`` bytes) before suffix ``j`` (``nj`` bytes); a suffix that ends is before one that goes on."""
        most = np.minimum(ni, nj)
        c = self.common(i, j, most)
        inside = c < most
        at = np.where(inside, c, 0)
        top = len(self.data) - 1
        return np.where(inside, self.data[np.minimum(i + at, top)] < self.data[np.minimum(j + at, top)], ni < nj)

    def verified(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The first difference within ``n`` bytes, by the bytes themselves: hashes may collide."""
        out = n.copy()
        for lo in range(0, len(i), 4096):
            a, b, m = i[lo : lo + 4096, None], j[lo : lo + 4096, None], n[lo : lo + 4096]
            k = np.arange(int(m.max(initial=0)))[None, :]
            top = len(self.data) - 1
            differ = (self.data[np.minimum(a + k, top)] != self.data[np.minimum(b + k, top)]) & (k < m[:, None])
            out[lo : lo + 4096] = np.where(differ.any(1), differ.argmax(1), m) if k.size else m
        return out


def suffix_sort(text: Text, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes inside each (contiguous) group, and each one's common extension with the one before it (-1: none).

    Bottom-up merge sort of all groups in step: a place in the merged run is the place in one's own run
    plus the number of the other run's suffixes before it, by binary search.
    """
    n = len(start)
    head = np.append(True, group[1:] != group[:-1]) if n else np.zeros(0, bool)
    begin = np.flatnonzero(head)[np.cumsum(head) - 1] if n else np.zeros(0, np.int64)
    end = np.append(begin[1:][head[1:]], n)[np.cumsum(head) - 1] if n else begin
    order, run = np.arange(n), 1
    largest = int((end - begin).max(initial=0))
    while run < largest:
        place = np.arange(n) - begin
        block = place // (2 * run) * (2 * run) + begin
        right = (place // run) % 2 == 1
        mid = np.minimum(block + run, end)
        stop = np.minimum(block + 2 * run, end)
        lo, hi = np.where(right, block, mid), np.where(right, mid, stop)
        base = lo.copy()
        a, na = start[order], size[order]
        while (open_ := np.flatnonzero(lo < hi)).size:
            m = (lo[open_] + hi[open_]) // 2
            b, nb = a[m], na[m]
            r = right[open_]
            # a suffix of the left run goes before equal ones of the right run
            other_first = np.where(r, ~text.less(a[open_], b, na[open_], nb), text.less(b, a[open_], nb, na[open_]))
            lo[open_] = np.where(other_first, m + 1, lo[open_])
            hi[open_] = np.where(other_first, hi[open_], m)
        own = np.where(right, np.arange(n) - mid, np.arange(n) - block)
        merged = np.empty_like(order)
        merged[block + own + (lo - base)] = order
        order, run = merged, run * 2
    i, j = start[order[:-1]], start[order[1:]]
    most = np.minimum(size[order[:-1]], size[order[1:]])
    inner = ~head[1:] if n else head
    common = np.full(n, -1, np.int64)
    c = text.common(i[inner], j[inner], most[inner])
    common[1:][inner] = text.verified(i[inner], j[inner], c)
    return order, common


def repeated(data: np.ndarray, offset: np.ndarray, before: np.ndarray, after: np.ndarray, spare: np.ndarray, group: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(member, window start before its anchor) of all repeated windows.

    A member's anchor is at ``offset``; its windows start ``before`` to ``spare`` bytes before it, and ``after`` bytes from it on are known.
    """
    order, common = suffix_sort(Text(data), offset, after, group)
    gap = common
    at, back, spare = offset[order], before[order], spare[order]
    class_ = np.cumsum(np.append(True, group[1:] != group[:-1]))  # order stays inside groups
    live = np.arange(len(order))
    found_m, found_s = [], []
    for s in range(int(before.max(initial=0)) + 1):
        if s:
            live = live[back[live] >= s]
            if not len(live):
                break
            _, c = np.unique(class_[live] * 256 + data[at[live] - s], return_inverse=True)
            many = np.bincount(c)
            live, c = live[many[c] > 1], c[many[c] > 1]
            class_[live] = c
        far = np.cumsum(gap < window - s)  # runs of suffixes that share the window's right part
        ok = live[spare[live] <= s]
        if not len(ok):
            continue
        _, c, many = np.unique(class_[ok] * (len(order) + 1) + far[ok], return_inverse=True, return_counts=True)
        hit = ok[many[c] > 1]
        found_m.append(order[hit])
        found_s.append(np.full(len(hit), s))
    if not found_m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_m), np.concatenate(found_s)


def _runs(doc: np.ndarray, x: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals [begin, end) that windows at ``x`` of ``doc`` cover, joined where they overlap."""
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (x[1:] > x[:-1] + window)) if len(x) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1 if len(x) else first
    return doc[first], x[first], x[last] + window


_SPAN = "doc long, bytes long, begin long, end long"


def _spans(doc: np.ndarray, size: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(v, np.int64)) for v in (doc, size, begin, end)], names=["doc", "bytes", "begin", "end"])


def repeated_spans(docs: DataFrame, tables: Written, text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc, bytes, begin, end``: spans of repeated windows by the text's hash and length, of texts that occur once or more."""
    key = [F.xxhash64("t").alias("doc"), F.octet_length("t").cast("long").alias("bytes")]
    texts = docs.select(F.col(text_col).cast("string").cast("binary").alias("t")).where(F.octet_length("t") >= window).select(*key, "t")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # copies in a task's own rows are marked once
        for batch in batches:
            out: list[list[np.ndarray]] = []
            for doc, size, t in zip(*batch.columns, strict=True):
                one = (doc.as_py(), size.as_py())
                if one in seen:
                    continue
                seen.add(one)
                at, h, x0, x1 = anchors(np.frombuffer(t.as_buffer(), np.uint8), window, gram)
                out.append([h.view(np.int64), np.full(len(at), one[0]), np.full(len(at), one[1]), at, x0 * 256 + (x1 - x0)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["gram", "doc", "bytes", "at", "starts"])

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, sorted, without equal ones and those whose gram is on no other row."""
        held: pa.RecordBatch | None = None
        known = None  # the gram before the held row, if it was given out
        for batch in batches:
            t = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            g, d, b, a = (t.column(c).to_numpy() for c in ("gram", "doc", "bytes", "at"))
            new = np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (b[1:] != b[:-1]) | (a[1:] != a[:-1]))
            t, g = t.filter(pa.array(new)), g[new]
            if not len(g):
                continue
            same = np.append(known is not None and known == g[0], g[1:] == g[:-1])
            keep = same | np.append(g[1:] == g[:-1], False)
            keep[-1] = False
            if len(g) > 1:
                known = g[-2]
            held = t.slice(len(g) - 1)
            yield t.filter(pa.array(keep))
        if held is not None and known is not None and known == held.column("gram")[0].as_py():
            yield held

    cols = "gram long, doc long, bytes long, at long, starts long"
    rows = texts.mapInArrow(mark, cols).repartition("gram").sortWithinPartitions("gram", "doc", "bytes", "at").mapInArrow(twice, cols)
    rows = tables.cut(rows, "anchors")
    hot = tables.cut(rows.groupBy("gram").count().where(F.col("count") > group).select("gram"), "hot")
    some_hot = not hot.isEmpty()
    wanted = rows.groupBy("doc", "bytes").agg(F.collect_list(F.struct("gram", "at", "starts")).alias("marks"))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            d, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new = [one not in seen and not seen.add(one) for one in zip(d, b, strict=True)]
            yield batch.filter(pa.array(new))

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out: list[tuple] = []
            room = 0
            for doc, size, marks, t in zip(*batch.columns, strict=True):
                one = (doc.as_py(), size.as_py())
                if one == last:
                    continue
                last, raw = one, t.as_py()
                for m in marks.as_py():
                    x0, more = divmod(m["starts"], 256)
                    out.append((m["gram"], *one, m["at"], x0, x0 + more, raw[x0 : x0 + more + window]))
                    room += more + window
                    if room > 1 << 23:
                        yield pack(out)
                        out, room = [], 0
            if out:
                yield pack(out)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        *ints, around = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in ints), pa.array(around, pa.binary())], names=["gram", "doc", "bytes", "at", "x0", "x1", "around"])

    wide = "gram long, doc long, bytes long, at long, x0 long, x1 long, around binary"
    met = texts.mapInArrow(alone, "doc long, bytes long, t binary").join(wanted, ["doc", "bytes"]).select("doc", "bytes", "marks", "t").mapInArrow(surround, wide)
    if some_hot:
        met = tables.cut(met, "met")  # rows that repeat go where they are sorted or counted

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch:
            g, d, b, a, x0, x1 = (t.column(c).to_numpy() for c in ("gram", "doc", "bytes", "at", "x0", "x1"))
            new = np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (b[1:] != b[:-1]) | (a[1:] != a[:-1]))
            g, d, b, a, x0, x1 = (v[new] for v in (g, d, b, a, x0, x1))
            around = t.column("around").filter(pa.array(new)).to_pylist()
            data = np.frombuffer(b"".join(around), np.uint8)
            size = x1 - x0 + window
            begin = np.cumsum(size) - size
            m, s = repeated(data, begin + a - x0, a - x0, size - (a - x0), a - x1, g, window)
            codes, of = np.unique(np.stack([d, b], 1), axis=0, return_inverse=True)
            doc, lo, hi = _runs(of.ravel()[m], a[m] - s, window)
            return _spans(codes[doc, 0], codes[doc, 1], lo, hi)

        held: list[pa.RecordBatch] = []
        room = 0
        for batch in batches:
            held.append(batch)
            room += batch.nbytes
            if room < ROOM:
                continue
            t = pa.Table.from_batches(held)
            g = t.column("gram").to_numpy()
            cut = np.flatnonzero(g[1:] != g[:-1])
            if not len(cut):
                continue
            yield done(t.slice(0, cut[-1] + 1))
            held = t.slice(cut[-1] + 1).combine_chunks().to_batches()
            room = sum(x.nbytes for x in held)
        if held:
            yield done(pa.Table.from_batches(held))

    small = met.join(hot, "gram", "left_anti") if some_hot else met
    spans = small.repartition("gram").sortWithinPartitions("gram", "doc", "bytes", "at").mapInArrow(sort, _SPAN)
    if some_hot:
        large = met.join(hot, "gram", "left_semi").select("doc", "bytes", "x0", F.explode(F.sequence("x0", "x1")).alias("x"), "around")
        own = F.substring("around", (F.col("x") - F.col("x0") + 1).cast("int"), F.lit(window))
        large = tables.cut(large.select("doc", "bytes", "x", F.xxhash64(own).alias("p"), F.xxhash64(F.lit(1), own).alias("q")).distinct(), "windows")
        often = large.groupBy("p", "q").count().where("count > 1").select("p", "q")
        spans = spans.union(large.join(often, ["p", "q"], "left_semi").select("doc", "bytes", F.col("x").alias("begin"), (F.col("x") + window).alias("end")))
    return tables.cut(spans, "spans")


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Every row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and ``spans`` (begin, end of each removed run).

    Null and empty texts have no bytes. Texts are whole rows: one that stands on two rows, of ``window`` bytes or more,
    goes on both. Ids aren't looked at, null and repeated ones are rows like any other. Texts are told apart by a hash of 64 bits and their length.
    """
    tables = Written(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).select("doc_id", F.xxhash64("t").alias("doc"), F.octet_length("t").cast("long").alias("bytes"), "t")
    copies = rows.groupBy("doc", "bytes").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("bytes") >= window))
    spans = repeated_spans(docs, tables, text_col, window, gram, group)
    found = spans.groupBy("doc", "bytes").agg(F.collect_list(F.struct("begin", "end")).alias("s"))
    whole = copies.select("doc", "bytes", F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("bytes").alias("end"))).alias("s"))
    cuts = tables.cut(found.join(copies, ["doc", "bytes"], "left_anti").union(whole), "cuts")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            removed, runs, digests = [], [], []
            for t, s in zip(batch.column(2), batch.column(3), strict=True):
                joined: list[dict[str, int]] = []
                for x in sorted(s.as_py() or [], key=lambda x: x["begin"]):
                    if joined and x["begin"] <= joined[-1]["end"]:
                        joined[-1]["end"] = max(joined[-1]["end"], x["end"])
                    else:
                        joined.append(dict(x))
                view, sha, at = memoryview(t.as_buffer()), hashlib.sha256(), 0
                for x in joined:
                    sha.update(view[at : x["begin"]])
                    at = x["end"]
                sha.update(view[at:])
                removed.append(sum(x["end"] - x["begin"] for x in joined))
                runs.append(joined)
                digests.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(digests), pa.array(runs, kind)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    met = rows.join(cuts, ["doc", "bytes"], "left").select("doc_id", "bytes", "t", "s")
    return met.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>")
