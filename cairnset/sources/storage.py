"""Stored tables: Parquet in a folder that driver and executors share, checked schemas, codecs and storage levels."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Where intermediate data may live, by kind of temporary storage.
LEVELS = {"program": StorageLevel.MEMORY_ONLY, "shared": StorageLevel.MEMORY_AND_DISK, "fast_file": StorageLevel.MEMORY_AND_DISK, "slow_file": StorageLevel.DISK_ONLY}
CODECS = ("zstd", "snappy", "gzip", "uncompressed")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset a local session (tests) gets a temporary one; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cairnset-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def store(frame: DataFrame, codec: str = "zstd", partition_by: list[str] | None = None, path: str | None = None) -> str:
    """Writes a table and returns its path."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec}")
    path = path or f"{shared_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = frame.write.mode("overwrite").option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def append(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").parquet(path)


def open_checked(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at ``path``; raises if a column of ``schema`` is missing or of another type."""
    frame = spark.read.parquet(path)
    have = {f.name: f.dataType for f in frame.schema}
    wrong = [f.name for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns of another version: {wrong}")
    return frame


def cut(frame: DataFrame) -> DataFrame:
    """The frame, written and reread, so that what follows doesn't recompute it."""
    return frame.sparkSession.read.schema(frame.schema).parquet(store(frame))


# stores of id sets: ``idx_id, item_id``; id 0 is the empty set and has no rows


def index_store(sets: DataFrame, key: str, item: str) -> tuple[DataFrame, DataFrame]:
    """``sets`` (``key, item``) as a store whose equal sets share an id, and the map ``key, idx_id``.

    A set's name is a digest over its members that needs no order: counts, sums and xors of two hashes; so
    no set is gathered in one row. Ids are ranks of the digests, counted per hash range.
    """
    rows = sets.select(F.col(key).alias("_k"), F.col(item).cast("long").alias("item_id")).where("item_id is not null").distinct()
    h, g = F.xxhash64("item_id"), F.xxhash64("item_id", F.lit(11))
    named = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("h"), F.bit_xor(g).alias("g"), F.min("item_id").alias("lo"), F.max("item_id").alias("hi"))
    digest = ["n", "h", "g", "lo", "hi"]
    firsts = named.groupBy(*digest).agg(F.min("_k").alias("first"))
    ids = positions(firsts, "first").withColumn("idx_id", F.col("position") + 1)
    of = named.join(ids, digest).select("_k", "idx_id", "first")
    stored = rows.join(of.where(F.col("_k") == F.col("first")), "_k").select("idx_id", "item_id")
    return stored, of.select(F.col("_k").alias(key), "idx_id")


def positions(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with their 0-based place in the order of ``key`` (unique): ranks within range partitions plus the rows before."""
    dealt = cut(rows.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    offsets = dealt.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return dealt.withColumn("_r", place).join(offsets, "_p").withColumn("position", F.col("_r") + F.col("_o")).drop("_p", "_r", "_o")


def merge_stores(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both stores as one; the map is ``store, old_id, idx_id``."""
    tagged = first.select(F.struct(F.lit(0).alias("store"), F.col("idx_id").alias("old_id")).alias("k"), "item_id").union(second.select(F.struct(F.lit(1), "idx_id"), "item_id"))
    stored, ids = index_store(tagged, "k", "item_id")
    return stored, ids.select("k.store", "k.old_id", "idx_id")
