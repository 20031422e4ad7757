"""Shared plumbing: written intermediates, word rules, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import large_star, small_star

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spare_name(taken: list[str]) -> str:
    """A column name that, in any case, isn't among ``taken``."""
    lower = {c.lower() for c in taken}
    return next(name for k in range(len(taken) + 1) if (name := f"_spare_{k}") not in lower)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns ``c0, c1, ...``, which no other column of an operator is called, and the new names by the old."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a local session (tests) gets a temporary one; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cairnset-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Written:
    """Tables written to the shared folder to cut lineage; ``drop`` frees those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/cairnset-{uuid.uuid4().hex}"

    def cut(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def collect(self) -> None:
        """Spark frees shuffle files once the driver has collected what refers to them: have that done now."""
        self.spark._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, tables: Written, name: str = "links") -> DataFrame:
    """Connected components of ``links`` (two long columns) by alternating large and small stars.

    Returns ``node, root``: each node that isn't the smallest of its component, with the smallest.
    Every round shuffles the links only and writes them to the shared folder; the stars' tasks hold
    a bounded number of links, and a hub's stream by.
    """
    a, b = links.columns
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, last, k = tables.cut(edges, f"{name}-0"), None, 0
    while True:
        seal = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seal == last or seal[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = seal
        large = tables.cut(large_star(edges, seal[0]), f"{name}-large-{k}")
        edges = tables.cut(small_star(large, seal[0]), f"{name}-{k + 1}")
        tables.drop(f"{name}-{k}")
        tables.drop(f"{name}-large-{k}")
        k += 1
