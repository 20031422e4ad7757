"""Id sets: distinct ``id`` columns, or sorted arrays per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sets).distinct()


def intersect(first: DataFrame, *rest: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, a.columns, "left_semi"), rest, first).distinct()


def difference(a: DataFrame, *gone: DataFrame) -> DataFrame:
    return reduce(lambda x, b: x.join(b, x.columns, "left_anti"), gone, a).distinct()


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One aggregate over both sides, tagged; no join."""
    (key,) = a.columns
    tagged = a.distinct().withColumn("_side", F.lit(1)).union(b.distinct().withColumn("_side", F.lit(2)))
    return tagged.groupBy(key).agg(F.sum("_side").alias("_s")).where("_s < 3").select(key)


def in_all(tagged: DataFrame, key: str, term: str, terms: int) -> DataFrame:
    """Ids that occur with each of ``terms`` terms: the n-ary intersection as one aggregate."""
    return tagged.groupBy(key).agg(F.countDistinct(term).alias("_n")).where(F.col("_n") == terms).select(key)


def unite_k(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest ids of the union."""
    (key,) = a.columns
    return union(a, b).orderBy(key).limit(k)


def and_minus_or(wanted: list[DataFrame], gone: list[DataFrame], k: int | None = None, keep: Column | None = None) -> DataFrame:
    """AND of ``wanted`` minus OR of ``gone``; the residual filter, then the limit."""
    out = difference(intersect(*wanted), *gone) if wanted else None
    if out is None:
        raise ValueError("no set to intersect")
    out = out if keep is None else out.where(keep)
    return out if k is None else out.orderBy(out.columns[0]).limit(k)


def remap(a: DataFrame, mapping: DataFrame, old: str, new: str) -> DataFrame:
    (key,) = a.columns
    return a.join(mapping, a[key] == mapping[old]).select(F.col(new).alias(key)).distinct()


def ranked(a: DataFrame, buckets: int = 1 << 20) -> DataFrame:
    """Ids with their position from 0. Counts per range of ids give the offsets, so that no window holds the whole set."""
    from pyspark.sql.window import Window

    (key,) = a.columns
    rows = a.distinct().withColumn("_b", F.floor(F.col(key) / buckets))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    return rows.withColumn("_p", place).join(offsets, "_b").select(key, (F.col("_p") + F.col("_o")).alias("position"))


# sorted arrays


def array_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def array_intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def array_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def array_symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def subset(a: Column, b: Column, proper: bool = False) -> Column:
    inside = F.size(F.array_except(a, b)) == 0
    return inside & (F.size(a) < F.size(b)) if proper else inside


def strictly_ascending(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == a


def bitmap(a: DataFrame) -> DataFrame:
    """``bucket, bits``: a bitmap per bucket of ids (shifted by one: ids 0 and 1 share a position otherwise)."""
    (key,) = a.columns
    shifted = F.col(key) + 1
    return a.groupBy(F.bitmap_bucket_number(shifted).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(shifted)).alias("bits"))
