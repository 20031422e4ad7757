"""Text predicates and string functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT, PREFIX, SUFFIX, SUBSTRING, NO_CASE, CASE = 1, 2, 4, 8, 16, 32
KINDS = {"exact": EXACT, "prefix": PREFIX, "suffix": SUFFIX, "substring": SUBSTRING}


def matches(s: Column, q: Column | str, kind: int) -> Column:
    """Does ``s`` match ``q``; of several kinds any, an exact or prefix kind shutting out the others."""
    q = F.lit(q) if isinstance(q, str) else q
    if kind & NO_CASE:
        s, q = F.lower(s), F.lower(q)
    kind &= EXACT | PREFIX if kind & (EXACT | PREFIX) else SUFFIX | SUBSTRING
    tests = [test for bit, test in ((EXACT, s == q), (PREFIX, F.startswith(s, q)), (SUFFIX, F.endswith(s, q)), (SUBSTRING, F.contains(s, q))) if kind & bit]
    return reduce(Column.__or__, tests, F.lit(False)) if tests else F.lit(False)


def any_matches(strs: Column, q: str, kind: int) -> Column:
    """Does any of an item's strings match."""
    return F.exists(strs, lambda s: matches(s, q, kind))


def normalize(q: str) -> tuple[str, int]:
    """Query text without its decoration, and the kind of match that this asks for."""
    kind = 0
    if q.startswith("?"):
        kind, q = (SUBSTRING, q[1:-1]) if len(q) > 1 and q.endswith("?") else (SUFFIX, q[1:])
    elif q.endswith("?"):
        kind, q = PREFIX, q[:-1]
    if len(q) > 1 and q[0] == q[-1] == '"':
        return q[1:-1], kind or EXACT
    return q, kind or SUBSTRING


def normalized(q: Column) -> Column:
    """``normalize`` as an expression: a struct of ``text`` and ``kind``."""
    first, last = F.startswith(q, F.lit("?")), F.endswith(q, F.lit("?"))
    kind = F.when(first & last & (F.length(q) > 1), SUBSTRING).when(first, SUFFIX).when(last, PREFIX).otherwise(0)
    bare = F.when(kind == SUBSTRING, F.substr(q, F.lit(2), F.length(q) - 2)).when(kind == SUFFIX, F.substr(q, F.lit(2))).when(kind == PREFIX, F.substr(q, F.lit(1), F.length(q) - 1)).otherwise(q)
    quoted = bare.rlike('(?s)^".*"$')
    return F.struct(F.when(quoted, F.substr(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare).alias("text"), F.when(kind > 0, kind).when(quoted, EXACT).otherwise(SUBSTRING).alias("kind"))


def to_available(requested: Column, available: Column) -> Column:
    """The kind that serves a request: a prefix may be served by exact, a substring by suffix; of several the highest."""
    asked = requested.bitwiseAND(F.lit(15))
    served = F.when(asked.bitwiseAND(available) > 0, asked).when(asked.bitwiseAND(F.lit(PREFIX)) > 0, available.bitwiseAND(F.lit(EXACT))).when(asked.bitwiseAND(F.lit(SUBSTRING)) > 0, available.bitwiseAND(F.lit(SUFFIX))).otherwise(0)
    return F.when(served >= 8, 8).when(served >= 4, 4).when(served >= 2, 2).otherwise(served)


def suffixes(s: Column, separators: str = "") -> Column:
    """All suffixes that start at a code point, or only those after a separator, the text itself first."""
    at = F.filter(F.sequence(F.lit(1), F.length(s)), lambda i: (i == 1) | (F.instr(F.lit(separators), F.substr(s, i - 1, F.lit(1))) > 0)) if separators else F.sequence(F.lit(1), F.length(s))
    return F.when(F.length(s) > 0, F.transform(at, lambda i: F.substr(s, i))).otherwise(F.array().cast("array<string>"))


def prefixes(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substr(s, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def next_char(s: Column, q: str) -> Column:
    """What follows a prefix; null if nothing does."""
    return F.when(F.startswith(s, F.lit(q)) & (F.length(s) > len(q)), F.substr(s, F.lit(len(q) + 1), F.lit(1)))


def split_escaped(s: Column, separator: str, escape: str = "\\") -> Column:
    """Fields between separators; an escaped character stands for itself; an empty last field goes."""
    sep, esc = (f"\\x{ord(c):02x}" for c in (separator, escape))
    fields = F.regexp_extract_all(F.concat(s, F.lit(separator)), F.lit(f"(?s)((?:{esc}.|[^{sep}{esc}])*){sep}"), F.lit(1))
    clean = F.transform(fields, lambda f: F.regexp_replace(f, f"(?s){esc}(.)", "$1"))
    return F.when(F.element_at(clean, -1) == "", F.slice(clean, F.lit(1), F.size(clean) - 1)).otherwise(clean)


def common_prefix_bytes(a: Column, b: Column) -> Column:
    """Bytes of UTF-8 that two strings share at their start."""
    x, y = F.hex(F.encode(a, "UTF-8")), F.hex(F.encode(b, "UTF-8"))
    n = F.least(F.length(x), F.length(y)) / 2
    whole = F.filter(F.sequence(F.lit(0), n.cast("int")), lambda i: F.substr(x, F.lit(1), i * 2) == F.substr(y, F.lit(1), i * 2))
    return F.array_max(whole)


def has_lower(s: Column) -> Column:
    """Any character that equals its lower form, digits included."""
    return F.exists(F.split(s, ""), lambda c: (c != "") & (F.lower(c) == c))


def has_upper(s: Column) -> Column:
    return F.exists(F.split(s, ""), lambda c: (c != "") & (F.upper(c) == c))


@F.pandas_udf(T.StringType())
def without_marks(s: pd.Series) -> pd.Series:
    """Letters without their nonspacing marks: no built-in function decomposes."""
    clean = lambda t: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))
    return s.map(clean, na_action="ignore")


def to_bool(s: Column) -> Column:
    return s.isin("yes", "true", "1")


def to_double(s: Column) -> Column:
    """The number at the start of a text; NaN without one."""
    head = F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(head.try_cast("double"), F.lit(float("nan")))


#: What stands after the backslash, by character.
JSON_ESCAPES = {"\\": "\\", '"': '"', "/": "/", "\b": "b", "\f": "f", "\n": "n", "\r": "r", "\t": "t"}
XML_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "'": "&apos;", '"': "&quot;"}


def escape_json(s: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit("\\" + kv[1])), JSON_ESCAPES.items(), s)


def escape_xml(s: Column) -> Column:
    """Entities, each with a backslash before it."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit("\\" + kv[1])), XML_ESCAPES.items(), s)


def escape_regex(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\^$.|?*+()\[\]{}\-])", r"\\$1")


def packed_code_points(s: Column) -> Column:
    """All code points of a text, four bytes each, highest first, made in one pass."""
    return F.encode(s, "UTF-32")


def from_packed(points: Column) -> Column:
    """Text of packed code points. The mark put before them is what a decoder takes for the order of bytes, so one that the text starts with stays."""
    return F.decode(F.concat(F.unhex(F.lit("0000FEFF")), points), "UTF-32")


def from_code_points(points: Column) -> Column:
    """Text of an array of code points, through their UTF-32 bytes."""
    return from_packed(F.unhex(F.array_join(F.transform(points, lambda p: F.lpad(F.hex(p.cast("long")), 8, "0")), "")))
