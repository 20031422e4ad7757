"""SentencePiece encoding and decoding by a batched numpy Viterbi.

A text is cut where no piece can lie across, a batch's distinct words are encoded once. Words of equal length advance together: hashes of all
substrings probe the sorted piece keys, and at every place the maximum over the pieces that end there leaves a backpointer.
In a unigram model a path's score is the sum of its pieces'. A BPE model's result is by merge order, not by a sum; there a path counts if every two neighbours
stay apart when merged by themselves. Of each prefix exactly one path does, and it is the result of the merges: a merge across a border would be one
within the two neighbours, as what is merged on one side of a border doesn't depend on the other side until then.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spare_name

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"
#: Bytes of text that are encoded together, and characters of words that advance together.
ROOM, CELLS = 1 << 21, 1 << 16
#: Words whose ids a worker keeps at about most, and bytes of each.
KNOWN, SHORT = 1 << 18, 64
_MUL, _ALL, _LEAD = 0x9E3779B97F4A7C15, (1 << 64) - 1, 18


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            n, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else number(at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MUL)
    return (x ^ (x >> np.uint64(29))) * np.uint64(_MUL)


class Lookup:
    """Values of distinct 64-bit keys: the keys are sorted once they are spread evenly, and found by their leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = _mixed(keys)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        keys = self.keys
        self.begin = np.searchsorted(keys, np.arange(1 << _LEAD, dtype=np.uint64) << np.uint64(64 - _LEAD)).astype(np.int32)
        self.many = np.diff(np.append(self.begin, len(keys))).astype(np.int8)
        self.most = int(self.many.max(initial=0))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are keys, and their values."""
        h = _mixed(h)
        lead = (h >> np.uint64(64 - _LEAD)).astype(np.int64)
        many = self.many[lead]
        left = np.flatnonzero(many)
        lead, many, h = lead[left], many[left], h[left]
        which, found = [np.zeros(0, np.int64)], [self.values[:0]]
        for k in range(self.most):
            if k:
                more = many > k
                left, lead, many, h = left[more], lead[more], many[more], h[more]
            at = self.begin[lead] + k
            hit = self.keys[at] == h
            which.append(left[hit])
            found.append(self.values[at[hit]])
        return np.concatenate(which), np.concatenate(found)


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    byte_fallback: bool
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, proto: bytes) -> Model:
        pieces, scores, types, kind, fallback, dummy = [], [], [], UNIGRAM, False, True
        for field, value in _fields(proto):
            if field == 1:
                own = dict(_fields(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                types.append(own.get(3, NORMAL))
            elif field == 2:
                own = dict(_fields(value))
                kind, fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif field == 3:
                own = dict(_fields(value))
                dummy = bool(own.get(3, 1))
                if own.get(2) or own.get(4, 1) or not own.get(5, 1):
                    raise ValueError("only models that take text as it is are supported")
        if kind not in (UNIGRAM, BPE) or USER in types:
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        return cls(pieces, scores, types, kind, fallback, dummy)

    @cached_property
    def unknown(self) -> int:
        return self.types.index(UNKNOWN)

    @cached_property
    def byte_ids(self) -> np.ndarray:
        out = np.full(256, self.unknown)
        for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)):
            if t == BYTE:
                out[int(p[3:5], 16)] = i
        return out

    @cached_property
    def normal(self) -> dict[str, int]:
        return {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}

    # encoding of distinct words

    @cached_property
    def symbols(self) -> tuple[np.ndarray, int]:
        """Symbol of each code point: the id of its piece, or a number from ``len(pieces)`` on; and how many there are."""
        n = len(self.pieces)
        table = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in self.normal.items():
            if len(p) == 1:
                table[ord(p)] = i
        return table, n + 0x110000

    @cached_property
    def rank(self) -> np.ndarray:
        return np.array(self.scores, np.float64)

    @cached_property
    def inside(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of each code point that is in a longer piece (0: none), and which two numbers are neighbours in a piece."""
        chars = sorted({c for p in self.normal if len(p) > 1 for c in p})
        number = np.zeros(0x110000, np.uint16)
        number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        near = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.normal:
            at = number[[ord(c) for c in p]]
            near[at[:-1], at[1:]] = True
        return number, near

    @cached_property
    def merges(self) -> tuple[Lookup, np.ndarray, np.ndarray, np.ndarray]:
        """Of a BPE model: when the pairs that make pieces, as ``left * size + right``, merge (early ones are small);
        when each symbol was made (-1: a character), and its two parts (-1: a character, or a piece that no merge makes)."""
        table, size = self.symbols
        when = np.full(size, -1)
        when[list(self.normal.values())] = np.unique(-self.rank[list(self.normal.values())], return_inverse=True)[1]
        parts, made = np.full((2, size), -1), {}
        for p, i in self.normal.items():
            if len(p) == 1:
                when[i] = -1
                continue
            for k in range(1, len(p)):
                a, b = (self.normal.get(x, int(table[ord(x)]) if len(x) == 1 else None) for x in (p[:k], p[k:]))
                if a is not None and b is not None:
                    made[a * size + b] = i
        for p, i in self.normal.items():
            if len(p) > 1 and (last := self._last_merge([int(table[ord(c)]) for c in p], i, made, when)):
                if max(when[x] for x in last) > when[i]:
                    raise ValueError(f"piece {p!r} comes before its parts")
                parts[:, i] = last
        pairs = np.array(list(made), np.int64).astype(np.uint64)
        return Lookup(pairs, when[np.array(list(made.values()), np.int64)]), when, parts[0], parts[1]

    def _last_merge(self, word: list[int], whole: int, made: dict[int, int], when: np.ndarray) -> tuple[int, int] | None:
        """The two symbols whose merge makes a piece out of its characters, if it is made."""
        size = self.symbols[1]
        while len(word) > 1:
            found = [(when[z], at, z) for at in range(len(word) - 1) if (z := made.get(word[at] * size + word[at + 1])) is not None]
            if not found:
                return None
            _, at, z = min(found)
            if z == whole:
                return word[0], word[1]
            word[at : at + 2] = [z]
        return None

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Do neighbours ``a`` and ``b`` of a BPE model stay apart: was no pair of their parts, at the border, to merge before it went into a longer part?

        Parts are taken back in the order in which they were made, latest first; of two merges at one time the left one is first.
        """
        pairs, when, left, right = self.merges
        size = self.symbols[1]
        out = np.ones(len(a), bool)
        live, a, b, until = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64), np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            hit, time = pairs.find((a * size + b).astype(np.uint64))
            hit = hit[time < until[hit]]
            out[live[hit]] = False
            ta, tb = when[a], when[b]
            go = (ta >= 0) | (tb >= 0)
            go[hit] = False
            live, a, b, ta, tb = live[go], a[go], b[go], ta[go], tb[go]
            first = ta > tb
            until = np.where(first, ta, tb + 1)
            a, b = np.where(first, right[a], a), np.where(first, b, left[b])
        return out

    @cached_property
    def keys(self) -> tuple[Lookup, int]:
        """The ids of the pieces of two characters and more by their hashes, and the longest piece's length."""
        h = {}
        for p, i in self.normal.items():
            if len(p) == 1 or self.kind == BPE and self.merges[2][i] < 0:
                continue
            x = 0
            for c in p:
                x = (x * _MUL + ord(c) + 1) & _ALL
            if h.setdefault(x, i) != i:
                raise ValueError("two pieces have the same hash")
        return Lookup(np.array(list(h), np.uint64), np.array(list(h.values()), np.int64)), max(map(len, self.normal), default=1)

    def _lattice(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in words of equal length (rows of code points): end, row, length, piece, by end."""
        n, length = s.shape
        keys, longest = self.keys
        prefix = np.zeros((n, length + 1), np.uint64)
        for e in range(length):
            prefix[:, e + 1] = prefix[:, e] * np.uint64(_MUL) + (s[:, e].astype(np.uint64) + np.uint64(1))
        row, end = np.divmod(np.arange(n * length), length)
        found = [(end + 1, row, np.ones(n * length, np.int64), self.symbols[0][s].ravel().astype(np.int64))]
        power = 1
        for k in range(1, min(longest, length) + 1):
            power = power * _MUL & _ALL
            if k == 1:
                continue
            h = prefix[:, k:] - prefix[:, :-k] * np.uint64(power)
            hit, ids = keys.find(h.ravel())
            row, begin = np.divmod(hit, length - k + 1)
            found.append((begin + k, row, np.full(len(row), k), ids))
        end, row, size, piece = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        return end[order], row[order], size[order], piece[order]

    def viterbi(self, s: np.ndarray) -> np.ndarray:
        """Best path of words of equal length (rows of code points): the id at each piece's first place, -1
        elsewhere; ``len(pieces) + code point`` for a character that is in no piece. Of equal scores the longest last piece's wins."""
        n, length = s.shape
        ends, rows, sizes, ids = self._lattice(s)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, length + 1), np.int64), np.full((n, length + 1), -1)
        if self.kind == UNIGRAM:
            unknown = min((self.scores[i] for i in self.normal.values()), default=0) - 10
            gain = np.where(ids < len(self.pieces), self.rank[np.minimum(ids, len(self.pieces) - 1)], unknown)
        bounds = np.searchsorted(ends, np.arange(1, length + 2))
        for e in range(1, length + 1):
            own = slice(bounds[e - 1], bounds[e])
            r, k, p = rows[own], sizes[own], ids[own]
            if self.kind == UNIGRAM:
                score = best[r, e - k] + gain[own]
            else:
                last = piece[r, e - k]
                score = np.zeros(len(r))
                inner = np.flatnonzero(last >= 0)
                score[inner[~self.apart(last[inner], p[inner])]] = -np.inf
            fits = np.flatnonzero(score > -np.inf)
            fits = fits[np.lexsort((k[fits], score[fits], r[fits]))]
            top = fits[np.append(r[fits[1:]] != r[fits[:-1]], True)]
            best[r[top], e], back[r[top], e], piece[r[top], e] = score[top], k[top], p[top]
        out, at = np.full((n, length), -1), np.full(n, length)
        left = np.arange(n)
        while len(left):
            begin = at[left] - back[left, at[left]]
            out[left, begin] = piece[left, at[left]]
            at[left] = begin
            left = left[begin > 0]
        return out

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where each word's begin (one more at the end)."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        points, size = _points(words)
        starts = np.cumsum(size) - size
        order = np.argsort(size, kind="stable")
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # ids and the word that each is of
        base = len(self.pieces)
        bounds = np.flatnonzero(np.diff(np.append(0, size[order])))
        for lo, hi in zip(bounds, np.append(bounds[1:], n), strict=True):
            length = int(size[order[lo]])
            step = max(1, CELLS // length)
            for at in range(lo, hi, step):
                own = order[at : min(hi, at + step)]
                s = self.viterbi(points[starts[own][:, None] + np.arange(length)])
                row, col = np.nonzero(s >= 0)
                parts.append((s[row, col], own[row]))
        ids, of = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
        # characters in no piece become bytes
        odd = ids >= base
        if odd.any():
            if self.byte_fallback:
                raw = [chr(c - base).encode("utf-8", "replace") for c in ids[odd].tolist()]
                many = np.ones(len(ids), np.int64)
                many[odd] = [len(b) for b in raw]
                where = np.repeat(odd, many)
                ids, of = np.repeat(ids, many), np.repeat(of, many)
                ids[where] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            else:
                ids[odd] = self.unknown
        order = np.argsort(of, kind="stable")
        return ids[order], np.append(0, np.cumsum(np.bincount(of, minlength=n)))

    @cached_property
    def _known(self) -> dict[bytes, bytes]:
        return {}

    def _recalled(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_words``; up to ``KNOWN`` short words are kept for later batches, then forgotten all at once."""
        known, names = self._known, words.cast(pa.large_binary()).to_pylist()
        if len(known) > KNOWN:
            known.clear()
        got = [known.get(w) for w in names]
        new = [i for i, g in enumerate(got) if g is None]
        ids, begin = self.encode_words(words.take(pa.array(new, pa.int64())))
        raw, ends = ids.astype(np.int32).tobytes(), (4 * begin).tolist()
        for k, i in enumerate(new):
            got[i] = raw[ends[k] : ends[k + 1]]
            if len(names[i]) <= SHORT:
                known[names[i]] = got[i]
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        return np.frombuffer(b"".join(got), np.int32), np.append(0, np.cumsum(size))

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The texts' words one after the other, cut between characters that are neighbours in no piece, and how many each text has."""
        marked = pc.replace_substring(texts, " ", SPACE)
        if self.dummy_prefix:
            marked = pc.if_else(pc.equal(pc.binary_length(marked), 0), marked, pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), marked, pa.scalar("", pa.large_string())))
        points, size = _points(marked)
        number, near = self.inside
        own = number[points]
        border = np.ones(len(points), bool)
        border[1:] = ~near[own[:-1], own[1:]]
        first = np.cumsum(size) - size
        border[first[size > 0]] = True
        offsets, data = _buffers(marked)
        data = data[offsets[0] : offsets[-1]]
        leads = np.flatnonzero((data & 0xC0) != 0x80)[border]
        begin = np.append(leads, len(data)).astype(np.int64)
        flat = pa.Array.from_buffers(pa.large_string(), len(leads), [None, pa.py_buffer(begin), pa.py_buffer(data)])
        upto = np.append(0, np.cumsum(border))
        return flat, upto[first + size] - upto[first]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (large strings without nulls) one after the other, and where each text's begin (one more at the end)."""
        flat, counts = self.words(texts)
        flat = flat.dictionary_encode()
        ids, begin = self._recalled(flat.dictionary)
        code = flat.indices.to_numpy()
        size = (begin[1:] - begin[:-1])[code]
        ends = np.append(0, np.cumsum(size))
        at = np.arange(ends[-1]) - np.repeat(ends[:-1] - begin[:-1][code], size)
        return ids[at], ends[np.append(0, np.cumsum(counts))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_batch(pa.array(texts, pa.large_string()))

    @cached_property
    def spelled(self) -> list[bytes]:
        of = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), UNUSED: lambda p: p.replace(SPACE, " ").encode(), BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: " ⁇ ".encode(), CONTROL: lambda p: b""}
        return [of[t](p) for p, t in zip(self.pieces, self.types, strict=True)]

    @cached_property
    def _spelling(self) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(b) for b in self.spelled])
        return np.frombuffer(b"".join(self.spelled), np.uint8), np.append(0, np.cumsum(size))

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts one after the other, and where each text's begin (one more at the end), of ids in the same form."""
        data, begin = self._spelling
        size = (begin[1:] - begin[:-1])[ids]
        upto = np.append(0, np.cumsum(size))
        out = data[np.arange(upto[-1]) - np.repeat(upto[:-1] - begin[:-1][ids], size)]
        cut = upto[ends]
        if self.dummy_prefix:
            first = cut[:-1][cut[:-1] < cut[1:]]
            first = first[out[first] == 32]
            gone = np.zeros(len(out) + 1, np.int64)
            gone[first + 1] = 1
            cut = cut - np.cumsum(gone)[cut]
            keep = np.ones(len(out), bool)
            keep[first] = False
            out = out[keep]
        return out, cut

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _model(proto: bytes) -> Model:
    """One model, with its tables, for all tasks of a worker."""
    return Model.parse(proto)


def _proto(path: str) -> bytes:
    with open(path, "rb") as f:
        proto = f.read()
    Model.parse(proto)
    return proto


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of large strings."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of large strings one after the other, and how many each has."""
    offsets, data = _buffers(texts)
    raw = data[offsets[0] : offsets[-1]].tobytes()
    return np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).astype(np.int64), pc.utf8_length(texts).to_numpy().astype(np.int64)


def _slices(texts: pa.Array, size: int = ROOM) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes; a longer text is a run by itself."""
    ends, begin = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()), 0
    while begin < len(texts):
        room = size + (ends[begin - 1] if begin else 0)
        end = max(begin + 1, int(np.searchsorted(ends, room, "right")))
        yield begin, end
        begin = end


def _large(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "").cast(pa.large_string())


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens", keep: bool = True, room: int = ROOM) -> DataFrame:
    """``docs`` (without the text if not ``keep``: then no worker holds it twice) with the ids of the whole text and their number. A null or empty text has none; bytes that aren't UTF-8 count as U+FFFD. Columns of these
    names are replaced; others, whatever their names, and repeated rows pass as they are. An empty table gives an empty one. Long texts are encoded
    whole, each by itself, others about ``room`` bytes at once. The model is read on the driver and sent along; nothing is shuffled."""
    proto = _proto(model)
    rest = [c for c in docs.columns if c not in (ids_col, count_col) and (keep or c != text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(proto)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for begin, end in _slices(texts, room):
                ids, ends = own.encode_batch(_large(texts.slice(begin, end - begin)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, end - begin).columns[:-1], lists, pa.array(np.diff(ends), pa.int64())], names=[*rest, ids_col, count_col])
        pa.default_memory_pool().release_unused()  # the worker stays, for tasks that may not need it

    schema = docs.select(*rest).schema.add(ids_col, T.ArrayType(T.IntegerType())).add(count_col, T.LongType())
    return docs.select(*rest, F.make_valid_utf8(F.col(text_col).cast("string")).alias(spare_name(rest))).mapInArrow(run, schema)


def _strings(data: np.ndarray, cut: np.ndarray) -> list[str]:
    view = memoryview(data)
    return [bytes(view[a:b]).decode("utf-8", "replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def decode(rows: DataFrame, model: str = MODEL, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids in place of a column ``text_col``; null ids have a null text, no ids an empty one; a null id among
    others or one out of range is an error. Other columns, whatever their names, and repeated rows pass as they are."""
    proto = _proto(model)
    rest = [c for c in rows.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(proto)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            flat = pc.list_flatten(lists)
            if flat.null_count:
                raise ValueError("a null among ids")
            texts = _strings(*own.decode_batch(flat.to_numpy().astype(np.int64), np.append(0, np.cumsum(size))))
            texts = pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*rest, text_col])

    return rows.select(*rest, F.col(ids_col).alias(spare_name(rest))).mapInArrow(run, rows.select(*rest).schema.add(text_col, T.StringType()))


def round_trip(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_tokens, same``: the ids of every row's text, and whether they decode to it (a null text to ''), in one pass over the rows.
    Ids aren't looked at, null and repeated ones are rows like any other; columns besides the two aren't read."""
    proto = _proto(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(proto)
        for batch in batches:
            for begin, end in _slices(batch.column(1)):
                texts = _large(batch.column(1).slice(begin, end - begin))
                ids, ends = own.encode_batch(texts)
                data, cut = own.decode_batch(ids, ends)
                offsets, raw = _buffers(texts)
                alike = np.diff(offsets) == np.diff(cut)
                if alike.all():
                    differ = np.append(0, np.cumsum(raw[offsets[0] : offsets[-1]] != data))
                    same = differ[cut[1:]] == differ[cut[:-1]]
                else:
                    same = np.array([a == b for a, b in zip(_strings(data, cut), texts.to_pylist(), strict=True)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), lists, pa.array(np.diff(ends), pa.int64()), pa.array(same)], names=["doc_id", "ids", "n_tokens", "same"])
        pa.default_memory_pool().release_unused()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("t"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, same boolean")
