"""The subpackage's queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html, lines, mix, pieces, quality, shard, simhash, suffix, warc
from .common import Written, read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(read(spark, sf_dir, "pages"), Written(spark))
    return warc.read(archives).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign(read(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.strip(read(spark, sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_sentencepiece, op3_html, op4_mix, op5_warc, op6_quality, op7_shard, op8_ann, op9_lines, op10_suffix)
}

#: WARC digests are base32 of SHA-1: 160 bits in groups of 20 (five hex digits, four letters).
ORACLES: dict[str, str] = {
    "op5_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, md5(coalesce(html, '')) AS m FROM pages
), d AS (
  SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h, m) AS first_id,
    list_transform(range(8), i -> CAST('0x' || substr(h, CAST(5 * i + 1 AS INT), 5) AS INT)) AS g
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), k -> substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((g[CAST(k // 4 + 1 AS INT)] >> CAST(5 * (3 - k % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d""",
}
