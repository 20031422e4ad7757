"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths over a batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Not code points of words: ASCII white space and the bytes that continue a UTF-8 sequence.
_NOT_CHARS = WHITE + bytes(range(0x80, 0xC0))
#: Largest share of word characters inside n-grams that repeat an earlier one, by n; of those in repeated lines.
COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINES, LINE_CHARS, SYMBOL_WORDS = 0.30, 0.20, 0.10
LEAST_WORDS, REPEAT = 50, 50
#: Bytes of text that are hashed together.
ROOM = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: number (equal words, equal numbers), text they are in, code points."""
    parts = pc.ascii_split_whitespace(texts)
    flat, of = pc.list_flatten(parts), pc.list_parent_indices(parts)
    real = pc.greater(pc.binary_length(flat), 0)
    flat, of = flat.filter(real), of.filter(real).to_numpy()
    coded = flat.dictionary_encode()
    number = coded.indices.to_numpy()
    chars = pc.utf8_length(coded.dictionary).to_numpy()
    return number.astype(np.int64), of, chars[number].astype(np.int64) if len(number) else np.zeros(0, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: is it anywhere twice; does an equal one stand before it."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def _cover(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The figures of each text, in order; ``texts`` are UTF-8."""
    m = len(texts)
    number, of, chars = _words(pa.array([t.decode("utf-8", "replace") for t in texts], pa.large_string()))
    size = len(number)
    per = lambda flags: np.bincount(of[flags], chars[flags], m) if size else np.zeros(m)
    out = {
        "n_words": np.bincount(of, minlength=m) if size else np.zeros(m, np.int64),
        "word_chars": np.array([len(t.translate(None, _NOT_CHARS)) for t in texts], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
    }
    # three-word windows by number: pairs are ranked, then (text, pair, third word) is packed, so equal keys are equal windows
    whole = of[2:] == of[:-2] if size > 2 else np.zeros(0, bool)
    repeat = np.zeros(size, bool)
    if whole.any():
        _, pair = np.unique(number[:-1] * np.int64(size) + number[1:], return_inverse=True)
        at = np.flatnonzero(whole)
        if size < 1 << 21 and m < 1 << 21:
            key = (of[at].astype(np.int64) << 42) | (pair[at].astype(np.int64) << 21) | number[at + 2]
        else:
            _, key = np.unique(np.stack([of[at], pair[at], number[at + 2]], 1), axis=0, return_inverse=True)
            key = key.ravel()
        repeat = _cover(at[_repeats(key)[0]], 3, size)
    out["n_repeat_words"] = np.bincount(of[repeat], minlength=m) if size else np.zeros(m, np.int64)
    # rolling hashes: the next length adds a word to the windows that still repeat; others can't repeat again
    base = _mix(number.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    at, h, length = np.arange(size), _mix(of.astype(np.uint64) * _ODD + np.uint64(7)), 0
    for n in range(1, max(COVERAGE) + 1):
        fits = at + n <= size
        at, h = at[fits], h[fits]
        fits = of[at + n - 1] == of[at] if len(at) else np.zeros(0, bool)
        at, h = at[fits], h[fits]
        h = _mix(h * np.uint64(0x100000001B3) + base[at + n - 1])
        if n >= min(COVERAGE):
            twice, later = _repeats(h)
            if n in COVERAGE:
                out[f"chars_{n}"] = per(_cover(at[later], n, size)).astype(np.int64)
            at, h = at[twice], h[twice]
    lines, line_dups, dup_chars = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    for i, t in enumerate(texts):
        real = [x for x in t.split(b"\n") if x.strip(WHITE)]
        lines[i] = len(real)
        if len(real) > 1 and len(seen := set(real)) < len(real):
            line_dups[i] = len(real) - len(seen)
            dup_chars[i] = sum(len(x.translate(None, _NOT_CHARS)) for x in real) - sum(len(x.translate(None, _NOT_CHARS)) for x in seen)
    out |= {"n_lines": lines, "n_dup_lines": line_dups, "dup_line_chars": dup_chars}
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEAT * out["n_words"])
    bad = out["base_failed"] | (out["n_dup_lines"] > LINES * lines) | (out["dup_line_chars"] > LINE_CHARS * out["word_chars"])
    bad |= out["n_symbols"] > SYMBOL_WORDS * out["n_words"]
    for n, most in COVERAGE.items():
        bad |= out[f"chars_{n}"] > most * out["word_chars"]
    return out | {"kept": ~bad}


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars", *(f"chars_{n}" for n in COVERAGE)]


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Every row of ``docs`` with its figures, ``base_failed`` and ``kept``: ``doc_id`` and the figures, or with ``keep`` the
    rows of ``docs`` that are kept, with their own columns only.

    A null or empty text has no words and fails. Ids aren't looked at: null and repeated ones are rows like any other.
    Texts are measured whole, about ``ROOM`` bytes of them at once (a longer one by itself); nothing is shuffled.
    """
    columns = docs.columns if keep else [id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            begin = 0
            while begin < batch.num_rows:
                texts, room, end = [], 0, begin
                while end < batch.num_rows and (not texts or room < ROOM):
                    texts.append((text[end].as_py() or "").encode())
                    room += len(texts[-1])
                    end += 1
                part, got = batch.slice(begin, end - begin), measure(texts)
                begin = end
                if keep:
                    kept = part.filter(pa.array(got["kept"]))
                    yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=columns)
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[c].astype(np.int64)) for c in FIGURES), *(pa.array(got[c]) for c in ("base_failed", "kept"))], names=["doc_id", *FIGURES, "base_failed", "kept"])
        pa.default_memory_pool().release_unused()  # the worker stays, for tasks that may not need it

    text = F.col(text_col).cast("string").alias("_whole_text")
    if keep:
        return docs.select("*", text).mapInArrow(run, docs.schema)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in FIGURES) + ", base_failed boolean, kept boolean")
