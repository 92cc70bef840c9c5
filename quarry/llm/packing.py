"""Best-fit packing of documents into sequences under several capacities.

Every piece uses tokens (its length), one document place and attention cost (its length squared); a sequence has a
capacity for each. Pieces are taken by falling length; each goes, among the sequences that it fits by every capacity,
to the one with the greatest weighted dot product of the piece's use and the sequence's residual shares turned round
(least room first), or to the one that leaves the residual vector of least norm. As a piece's use follows from its
length, pieces of equal length and sequences of equal content are interchangeable: the driver packs the histogram of
lengths (at most `tokens` rows), giving runs of equal sequences, and each piece finds its place by its rank among the
pieces of its length. So the packing is that of a sequential best fit over all pieces, and no piece reaches the driver.

Null and empty texts are one piece that holds only the end id. A document over the capacity is cut, counted from its
end, into full pieces; its first piece may be shorter. Repeated rows are packed each for itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import slices
from quarry.llm.tokens import encoder
from quarry.session import materialize, ship

TOKENS = 1024
END = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, tokens: int = TOKENS, end: int = END) -> DataFrame:
    """The pieces of each text: (doc_id, piece, start, length, ids_crc32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(path), np.array([end], "<u4").tobytes()
        for b in slices(batches, "text", 2 << 20):
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                ids += last
                n = len(ids) // 4
                at = [0, *range((n - 1) % tokens + 1, n + 1, tokens)]
                rows += [(doc, i, a, z - a, zlib.crc32(ids[4 * a : 4 * z])) for i, (a, z) in enumerate(zip(at, at[1:], strict=False))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], tokens: int = TOKENS, documents: int | None = None, attention: int | None = None, score: str = "dot", weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, offset): pieces of that length and those ranks lie at that offset
    of consecutive sequences. Capacities not given do not bind. Lengths over `tokens` are an error."""
    caps = np.array([tokens, documents or tokens, attention or tokens * tokens], float)
    weight = np.array(weights)
    if any(n > tokens or n < 1 or n * n > caps[2] for n in histogram):
        raise ValueError("a piece exceeds a capacity")
    # Groups of sequences with equal content: first sequence, use, count; and what each run of pieces becomes.
    base, used, count = [], np.zeros((0, 3)), np.zeros(0, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def group(first: int, use: np.ndarray, n: int) -> None:
        nonlocal used, count
        base.append(first)
        used, count = np.vstack([used, use]), np.append(count, n)

    for n in sorted(histogram, reverse=True):
        use, left, rank = np.array([n, 1, n * n], float), histogram[n], 0
        while left:
            fits = np.flatnonzero((caps - used >= use).all(axis=1) & (count > 0))
            if len(fits):
                share = (caps - used[fits] - use) / caps
                value = (weight * (use / caps) * share).sum(axis=1) if score == "dot" else (weight * share**2).sum(axis=1)
                g = fits[np.lexsort((fits, value))[0]]
                first, before, n_same = base[g], used[g].copy(), int(count[g])
            else:
                g, first, before, n_same = None, sequences, np.zeros(3), left
            # A sequence that takes a piece has less room and stays the best one until the next doesn't fit: sequences are
            # filled in turn, the last one perhaps in part.
            each = int(min(np.floor((caps - before) / use)))
            whole = min(n_same, left // each)
            part = left - whole * each if whole < n_same else 0
            for k in range(each):
                if whole:
                    rows.append((n, rank, rank + whole, first, int(before[0]) + k * n))
                    rank += whole
            for k in range(part):
                rows.append((n, rank, rank + 1, first + whole, int(before[0]) + k * n))
                rank += 1
            taken = whole + (part > 0)
            if g is None:
                sequences += taken
            else:
                base[g], count[g] = first + taken, n_same - taken
            if whole:
                group(first, before + each * use, whole)
            if part:
                group(first + whole, before + part * use, 1)
            left -= whole * each + part
        live = ((caps - used).min(axis=1) >= 1) & (count > 0)  # full groups take no more
        base, used, count = [b for b, x in zip(base, live, strict=True) if x], used[live], count[live]
    return rows


def pack(spark: SparkSession, made: DataFrame, tokens: int = TOKENS, **limits) -> DataFrame:
    """made (PIECES) with sequence_id and offset."""
    ship(spark)
    made = materialize(spark, made, "pieces")
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # A few thousand runs at most, as they come from at most `tokens` lengths.
    runs = spark.createDataFrame(plan(histogram, tokens, **limits), "length long, a long, z long, base long, offset long")
    # Ranks within a length: hashed parts of at most about 100,000 rows, and each part's first rank.
    parts = max(1, max(histogram.values(), default=0) // 100_000)
    dealt = made.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    ends = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    ends = ends.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    own = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", own).join(ends, ["length", "part"])

    rank = F.col("before") + F.col("own")
    placed = ranked.withColumn("rank", rank).join(F.broadcast(runs), "length").where("rank >= a AND rank < z")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - F.col("a")).alias("sequence_id"), "offset")
