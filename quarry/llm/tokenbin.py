"""Token ids in files of Simple-8b words.

Simple-8b packs as many ids as fit into each 64-bit word: the top 4 bits select how many ids of how many bits the other
60 hold. Selector 0 is the escape: the next word is one id in full. A file holds blocks and an index:

  block   4 unsigned 32-bit numbers (words, ids, documents, 0), the documents' ids (64-bit), a byte each that is 1
          where the id is null, padded to 8, their token counts (64-bit), then the words
  index   the byte offset, first token and document count of each block (64-bit each)
  tail    number of blocks, number of tokens (64-bit), "QSIMPLE8"

All little-endian. Documents stand in ascending doc_id order (null ids last, then by text); a block ends after the
document with which it reaches BLOCK ids, so it can be decoded alone; its words decode selector by selector as arrays.

Null and empty texts hold only the end id. Repeated rows are written each for itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import slices
from quarry.llm.files import reading_at, written
from quarry.llm.tokens import encoder
from quarry.session import materialize, scratch_path, ship

END = 2
BLOCK = 1 << 16
MAGIC = b"QSIMPLE8"
# Fixed values of the code: ids and bits by selector; 0 is the escape.
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_LIMITS = np.array([1 << b for b in BITS[1:]], np.uint64)
_WIDTH = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)


def pack_words(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned 64-bit ids; each word takes as many as it can."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    # width: how many of the selectors' sizes an id exceeds; 14 means escape. most[k]: the largest of 2**k from each place on.
    width = np.zeros(n + 64, np.uint8)
    width[n:] = 255
    small = int(ids.max()) < 1 << 16
    width[:n] = _WIDTH[ids.astype(np.intp)] if small else np.searchsorted(_LIMITS, ids, "right")
    most = [width]
    for k in range(5):
        most.append(np.maximum(most[-1][: len(most[-1]) - (1 << k)], most[-1][1 << k :]))
    choice = np.zeros(n, np.int8)
    for s in range(14, 0, -1):  # fewer bits, so more ids, win
        c = COUNTS[s]
        k = c.bit_length() - 1
        full = np.maximum(most[k][:n], most[k][c - (1 << k) : c - (1 << k) + n])
        choice[full < s] = s
    step = np.array(COUNTS)[choice].tolist()
    at, starts = 0, []
    push = starts.append
    while at < n:
        push(at)
        at += step[at]
    starts = np.array(starts)
    chosen = choice[starts]
    size = np.where(chosen == 0, 2, 1)
    place = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    for s in range(1, 15):
        own = starts[chosen == s]
        if len(own):
            word = np.full(len(own), np.uint64(s) << np.uint64(60), np.uint64)
            for k in range(COUNTS[s]):
                word |= ids[own + k] << np.uint64(k * BITS[s])
            out[place[chosen == s]] = word
    out[place[chosen == 0] + 1] = ids[starts[chosen == 0]]
    return out


def unpack_words(words: np.ndarray) -> np.ndarray:
    """The ids of pack_words' result."""
    words = np.asarray(words, np.uint64)
    if not len(words):
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    escape = np.zeros(len(words), bool)
    if (selector == 0).any():  # a raw word may look like an escape itself: take them in turn
        last = -2
        for i in np.flatnonzero(selector == 0).tolist():
            if i != last + 1 or not escape[last]:
                escape[i], last = True, i
    raw = np.concatenate([[False], escape[:-1]])
    count = np.array([*COUNTS, 0])[selector]
    count[escape] = 0
    count[raw] = 1
    first = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    for s in range(1, 15):
        own = np.flatnonzero((selector == s) & ~raw)
        if len(own):
            low = np.uint64((1 << BITS[s]) - 1)
            for k in range(COUNTS[s]):
                out[first[own] + k] = (words[own] >> np.uint64(k * BITS[s])) & low
    out[first[raw]] = words[raw]
    return out


def _block(docs: list[int | None], coded: list[np.ndarray]) -> tuple[bytes, int]:
    ids = np.concatenate(coded)
    words = pack_words(ids)
    n = len(docs)
    null = np.array([d is None for d in docs], np.uint8).tobytes()
    head = struct.pack("<4I", len(words), len(ids), n, 0) + np.array([d or 0 for d in docs], "<i8").tobytes() + null + bytes(-n % 8)
    return head + np.array([len(c) for c in coded], "<i8").tobytes() + words.astype("<u8").tobytes(), len(ids)


class Writer:
    """Writes documents to a stream."""

    def __init__(self, out, block: int = BLOCK):
        self.out, self.block = out, block
        self.docs, self.coded, self.held = [], [], 0
        self.index, self.at, self.tokens, self.n_docs = [], 0, 0, 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.coded.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self.flush()

    def flush(self) -> None:
        if self.docs:
            data, n = _block(self.docs, self.coded)
            self.out.write(data)
            self.index.append((self.at, self.tokens, len(self.docs)))
            self.at, self.tokens, self.n_docs = self.at + len(data), self.tokens + n, self.n_docs + len(self.docs)
            self.docs, self.coded, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(np.array(self.index, "<i8").tobytes() + struct.pack("<2q", len(self.index), self.tokens) + MAGIC)


def read_blocks(stream, size: int) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, token counts, ids) of each block of a seekable stream of `size` bytes."""
    stream.seek(size - 24)
    n, _ = struct.unpack("<2q", stream.read(16))
    if stream.read(8) != MAGIC:
        raise ValueError("not a token file")
    stream.seek(size - 24 - 24 * n)
    for at, _, _ in np.frombuffer(stream.read(24 * n), "<i8").reshape(-1, 3).tolist():
        stream.seek(at)
        words, tokens, docs, _ = struct.unpack("<4I", stream.read(16))
        ids = np.frombuffer(stream.read(8 * docs), "<i8").tolist()
        null = stream.read(docs + -docs % 8)
        counts = np.frombuffer(stream.read(8 * docs), "<i8")
        flat = unpack_words(np.frombuffer(stream.read(8 * words), "<u8"))
        if len(flat) != tokens or int(counts.sum()) != tokens:
            raise ValueError("a block's counts disagree")
        yield [None if x else d for d, x in zip(ids, null, strict=False)], counts, flat


def write(spark: SparkSession, docs: DataFrame, path: str, folder: str, end: int = END) -> DataFrame:
    """Tokenize and write all texts; (part, file, n_docs, n_tokens, n_bytes) of each file, parts in doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, encode, last = f"{folder}/part-{part:06d}.s8b", encoder(path), np.array([end], "<u4").tobytes()
        with written(name) as out:
            w = Writer(out)
            for b in batches:
                for piece in slices([b], "text", 2 << 20):
                    for doc, ids in zip(piece.column("doc_id").to_pylist(), encode([t or "" for t in piece.column("text").to_pylist()]), strict=True):
                        w.add(doc, np.frombuffer(ids + last, "<u4"))
            w.close()
        size = w.at + 24 * len(w.index) + 24
        yield pa.record_batch([pa.array([x], t) for x, t in ((part, pa.int32()), (name, pa.string()), (w.n_docs, pa.int64()), (w.tokens, pa.int64()), (size, pa.int64()))], names=["part", "file", "n_docs", "n_tokens", "n_bytes"])

    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc()]
    dealt = rows.repartitionByRange(n, order[0]).sortWithinPartitions(*order)
    made = dealt.mapInArrow(run, "part int, file string, n_docs long, n_tokens long, n_bytes long")
    # A row for each file, so the list is one table file, not as many as there are files.
    return materialize(spark, made.repartition(1), "token-list")


def read(spark: SparkSession, files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, read from the files; start counts the ids of all files before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, before, size in zip(*(b.column(c).to_pylist() for c in ("file", "before", "n_bytes")), strict=True):
                with reading_at(name) as f:
                    at = before
                    for docs, counts, flat in read_blocks(f, size):
                        ends = np.concatenate([[0], np.cumsum(counts)])
                        raw = flat.astype("<u4")
                        out = {
                            "doc_id": pa.array(docs, pa.int64()),
                            "start": pa.array(at + ends[:-1], pa.int64()),
                            "n_tokens": pa.array(counts, pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(raw[a:z].tobytes()) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64()),
                        }
                        if with_ids:
                            out["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(raw.astype(np.int64)))
                        at += int(ends[-1])
                        yield pa.record_batch(out)

    ship(spark)
    # A row for each file: a prefix sum over the files.
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    listed = files.select("file", "n_bytes", before.alias("before"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def round_trip(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Write the documents' ids to files in the shared folder and read them back."""
    return read(spark, write(spark, docs, path, scratch_path(spark, "tokens")))
