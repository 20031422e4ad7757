"""WARC archives: one gzip member per record, written by Spark's own writer and read sequentially.

Archives live as rows ``archive, part, content`` of a table in the shared folder, so any store that Spark
writes to will do and a lost executor's archives are written again. ``content`` is a whole WARC
file; ``export`` turns rows into ``.warc.gz`` files where a folder is mounted, ``read_files`` reads such files.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written

#: Compressed bytes after which a task begins another archive.
ARCHIVE = 16 << 20
RECORD = "urn:page:"
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member of its own (zero time stamp: reruns agree)."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


class Damaged(ValueError):
    """A record that breaks the framing or whose digest is wrong."""


def records(chunks: Iterable[bytes], verify: bool = True) -> Iterator[Record]:
    """Sequential reader: one gzip member at a time, decompressed as chunks come, framed by content length."""
    source, raw = iter(chunks), b""
    while True:
        while not raw:
            try:
                raw = next(source)
            except StopIteration:
                return
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not raw:
                raw = next(source, b"")
                if not raw:
                    raise Damaged("a member ends early")
            parts.append(z.decompress(raw))
            raw = z.unused_data
        data = b"".join(parts)
        head, gap, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not gap or not lines[0].startswith("WARC/"):
            raise Damaged("no WARC header")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise Damaged("the content length doesn't frame the record")
        record = Record(headers, rest[:n])
        if verify and headers.get("WARC-Block-Digest", f"sha1:{digest(record.block)}") != f"sha1:{digest(record.block)}":
            raise Damaged("the block digest is wrong")
        if verify and headers["WARC-Type"] == RESPONSE and headers["WARC-Payload-Digest"] != f"sha1:{digest(record.block)}":
            raise Damaged("the payload digest is wrong")
        yield record


def _record(page: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    own = digest(payload)
    headers = [("WARC-Type", RESPONSE if first is None else REVISIT)]
    headers += [("WARC-Record-ID", f"<{RECORD}{'' if page is None else page}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    headers += [("WARC-Target-URI", " ".join(url.split()))] if url else []
    headers += [("WARC-Payload-Digest", f"sha1:{own}"), ("WARC-Payload-Length", str(len(payload)))]
    if first is not None:
        headers += [("WARC-Refers-To", f"<{RECORD}{first}>"), ("WARC-Profile", PROFILE)]
        payload = b""
    return member([*headers, ("WARC-Block-Digest", f"sha1:{digest(payload)}")], payload)


def write(pages: DataFrame, tables: Written, name: str = "archives", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, archive: int = ARCHIVE) -> DataFrame:
    """Archives of all rows. Of equal payloads of ``least`` bytes or more the smallest id is the response and others revisit
    it; rows that share that smallest id are all responses, a row with a null id revisits if another has an id. A null
    payload is empty; a null url leaves out the header. Other columns aren't read.

    Digests are grouped with a count and a minimum per task before the shuffle; only digests that recur are joined back.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha1("payload")))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("key").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    rows = rows.join(tables.cut(firsts, f"{name}-repeats"), "key", "left")
    rows = rows.select("page", "url", "payload", F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first")).alias("first"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([b"".join(held)], pa.binary())], names=["part", "content"])

        held, size, part = [], 0, 0
        for batch in batches:
            for page, url, payload, first in zip(*batch.columns, strict=True):
                held.append(_record(page.as_py(), url.as_py(), payload.as_py(), first.as_py()))
                size += len(held[-1])
                if size >= archive:
                    yield out()
                    held, size, part = [], 0, part + 1
        if held:
            yield out()

    return tables.cut(rows.mapInArrow(pack, "part int, content binary"), name)


def read(archives: DataFrame, content_col: str = "content", verify: bool = True) -> DataFrame:
    """A row per record: ``page, url, record_type, payload_bytes, payload_digest, refers_to, payload``."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def page(uri: str | None) -> int | None:
            tail = (uri or "").strip("<>").removeprefix(RECORD)
            return int(tail) if tail else None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema)

        schema = pa.schema([("page", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                view, rows, size = content.as_py(), [], 0
                for r in records((view[i : i + 65536] for i in range(0, len(view), 65536)), verify):
                    h = r.headers
                    rows.append({"page": page(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"), "record_type": h["WARC-Type"], "payload_bytes": int(h.get("WARC-Payload-Length", len(r.block))), "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": page(h.get("WARC-Refers-To")), "payload": r.block})
                    size += len(r.block) + 200
                    if size > 1 << 23:
                        yield out()
                        rows, size = [], 0
                if rows:
                    yield out()

    return archives.select(content_col).mapInArrow(unpack, "page long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def export(archives: DataFrame, folder: str) -> None:
    """Each archive as a ``.warc.gz`` in a folder that every executor mounts; a task that runs again writes the same names."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                name = f"{folder}/{hashlib.sha1(data).hexdigest()}.warc.gz"
                with open(f"{name}.{os.getpid()}", "wb") as f:
                    f.write(data)
                os.replace(f"{name}.{os.getpid()}", name)
        yield pa.RecordBatch.from_arrays([pa.array([0])], names=["done"])

    archives.select("content").mapInArrow(save, "done long").count()


def read_files(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """Records of the ``.warc.gz`` files under ``path``, through Spark's file reader."""
    return read(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path), "content", verify)
