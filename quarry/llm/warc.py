"""WARC archives: a writer, and a sequential reader with one gzip member for each record.

The reader decompresses a member at a time with zlib, piece by piece, frames records by their Content-Length, and
verifies payload digests (base32 SHA-1). It holds one record. A record that is damaged is an error, with the file's name.

Of records with equal payloads of at least `least` bytes the one with the largest page_id is the response and the
others are revisits that refer to it; smaller payloads are all responses. Null page_ids count as the smallest and are
written without an id; of repeated rows one (the first by url) is the response. Null html is the empty payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.files import reading, written
from quarry.session import materialize, scratch_path, ship

LEAST = 0
_DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit holds the response's head, whose Content-Length is the full payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + deflate.flush()


def members(stream, piece: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream, read a piece at a time."""
    at, rest = 0, b""
    while True:
        rest = rest or stream.read(piece)
        if not rest:
            return
        inflate, out, begun = zlib.decompressobj(31), io.BytesIO(), at
        while not inflate.eof:
            rest = rest or stream.read(piece)
            if not rest:
                raise ValueError(f"the member at {begun} ends early")
            out.write(inflate.decompress(rest))
            at += len(rest) - len(inflate.unused_data)
            rest = inflate.unused_data
        yield begun, out.getvalue()


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Head and block of a record, framed by its Content-Length."""
    head, found, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length isn't its Content-Length")
    return fields, rest[:n]


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_records(stream) -> Iterator[tuple]:
    for at, content in members(stream):
        fields, block = parse(content)
        head, _, payload = block.partition(b"\r\n\r\n")
        n = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        said = fields["warc-payload-digest"].removeprefix("sha1:")
        revisit = fields["warc-type"] == "revisit"
        if not revisit and (len(payload) != n or digest(payload) != said):
            raise ValueError(f"the payload of {fields['warc-record-id']} isn't that of its digest")
        yield _page(fields["warc-record-id"]), fields.get("warc-target-uri"), n, said, fields["warc-type"], _page(fields.get("warc-refers-to")), at, payload


def deduplicated(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages' rows as (page_id, url, html, refers_to, revisit). Digests are compared in a slim table; the pages
    themselves move only by their id, so that a payload with very many copies lands in no one task."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # k is page_id with a value for null, so that the join and the window deal the rows by the same key, once.
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8"))).withColumn("k", F.coalesce("page_id", F.lit(-(2**63))))
    slim = rows.where(F.octet_length("html") >= least).select("k", "sha")
    groups = slim.groupBy("sha").agg(F.max("k").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    made = rows.join(slim.distinct().join(groups, "sha"), ["k", "sha"], "left")
    nth = F.row_number().over(W.partitionBy("k", "sha").orderBy("url"))
    revisit = F.col("first").isNotNull() & ~((F.col("k") == F.col("first")) & (F.col("nth") == 1))
    first = F.when(revisit & (F.col("first") > F.lit(-(2**63))), F.col("first"))
    return made.withColumn("nth", nth).select("page_id", "url", "html", first.alias("refers_to"), revisit.alias("revisit"))


def write(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """Write an archive for each partition of rows; (archive, n_records, n_bytes) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        n = size = 0
        with written(path) as out:
            for b in batches:
                for page, url, text, refers, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                    data = record(page, url, text.encode(), refers, revisit)
                    out.write(data)
                    n, size = n + 1, size + len(data)
        yield pa.record_batch({"archive": pa.array([path]), "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    ship(spark)
    return materialize(spark, rows.mapInArrow(run, "archive string, n_records long, n_bytes long"), "warc-list")


def read(spark: SparkSession, archives: DataFrame, payload: bool = False) -> DataFrame:
    """The records (RECORD[, payload]) of archives (a column archive), an archive a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "at", "payload"][: 9 if payload else 8]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)

        for b in batches:
            for path in b.column("archive").to_pylist():
                rows, size = [], 0
                with reading(path) as f:
                    for *fields, at, data in read_records(f):
                        rows.append((*fields, path, at, data))
                        size += len(data)
                        if len(rows) >= 2000 or size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(n, "archive").mapInArrow(run, RECORD + ", payload binary" * payload)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    return read(spark, write(spark, deduplicated(pages, least), scratch_path(spark, "warc")))
