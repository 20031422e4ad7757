"""Items as key/value pairs (arrays of structs, keys may repeat) and statistics over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.storage import positions


def pairs(**columns: Column | tuple[Column, ...]) -> Column:
    """Key/value pairs of columns; a tuple gives a key several values."""
    flat = [(k, v) for k, vs in columns.items() for v in (vs if isinstance(vs, tuple) else (vs,))]
    return F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in flat])


def value(kv: Column, key: str) -> Column:
    """The key's first value; an empty text without one."""
    return F.coalesce(F.get(F.filter(kv, lambda p: p["key"] == key), F.lit(0))["value"], F.lit(""))


def find(kv: Column, field: str, wanted: str, start: int = 0) -> Column:
    """First position from ``start`` of a key or value; -1 without one."""
    hits = F.filter(F.sequence(F.lit(0), F.size(kv) - 1), lambda i: (i >= start) & (F.get(kv, i)[field] == wanted))
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(-1))


def count(kv: Column, field: str, wanted: str) -> Column:
    return F.size(F.filter(kv, lambda p: p[field] == wanted))


def match_values(kv: Column, q: str, kind: int) -> Column:
    return F.exists(kv, lambda p: text.matches(p["value"], q, kind))


def upper_median(frame: DataFrame, group: str, column: str, tie: str) -> DataFrame:
    """``group, median``: the value at place n / 2 of each group in order. Places come from range partitions, so that no task holds a group."""
    rows = frame.where(F.col(column).isNotNull()).select(group, column, F.struct(F.col(group), F.col(column), F.col(tie)).alias("_key"))
    placed = positions(rows, "_key")
    middle = placed.groupBy(group).agg(F.min("position").alias("_first"), F.count(F.lit(1)).alias("_n")).select(group, (F.col("_first") + F.floor(F.col("_n") / 2)).alias("position"))
    return placed.join(middle, [group, "position"]).select(group, F.col(column).alias("median"))


def entropy(frame: DataFrame, column: str) -> DataFrame:
    """One row: -sum p log2 p over the column's values."""
    counts = frame.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select((F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


def regression(frame: DataFrame, order: str, y: str) -> DataFrame:
    """``slope, intercept`` of ``y`` over its place in the order; (1, 0) for an empty table."""
    fit = positions(frame.select(order, y), order).agg(F.regr_slope(y, "position").alias("a"), F.regr_intercept(y, "position").alias("b"))
    return fit.select(F.coalesce("a", F.lit(1.0)).alias("slope"), F.coalesce("b", F.lit(0.0)).alias("intercept"))


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm; 92 steps are enough for 64 bits."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.nullif(s["y"], F.lit(0))).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def fraction(num: Column, den: Column) -> Column:
    """A reduced fraction with a positive denominator."""
    g = F.greatest(gcd(num, den), F.lit(1))
    sign = F.when(den < 0, -1).otherwise(1)
    return F.struct((num * sign / g).cast("long").alias("num"), (den * sign / g).cast("long").alias("den"))


def saturated_add(a: Column, b: Column, most: int = (1 << 32) - 1) -> Column:
    return F.least(a + b, F.lit(most))


def top_bit(x: Column) -> Column:
    """Place of the highest set bit; -1 for zero."""
    return F.length(F.regexp_replace(F.bin(x), "^0+", "")) - 1


def tree_reduce(values: list[Column], join) -> Column:
    """Pairs, then pairs of pairs: the expression's depth grows with the logarithm."""
    while len(values) > 1:
        values = [reduce(join, values[i : i + 2]) for i in range(0, len(values), 2)]
    return values[0]
