"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest 64-bit hashes of a set's shingles. Sketches of parts merge into the
sketch of the whole (the k smallest of their union), and two sketches estimate resemblance,
containment and the number of distinct shingles. Written as text: "bk<k>.<words>:" and base64
of the sorted hashes, little-endian.

Shingles are five words, A-Z lower-cased. Null and empty texts, and texts without words, have
the empty sketch; two empty sketches are alike with 1.0, an empty and another one with 0.0.
Texts of one to four words are one shingle. Equal texts have equal sketches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import by_size, shingle_hashes, word_hashes
from quarry.session import ship

K, WORDS = 128, 5


def sketches(texts: list[bytes], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The bottom-k sketch of each text."""
    out: list[np.ndarray] = []
    for a, b in by_size(texts):
        h, offs = word_hashes(texts[a:b], lower=True)
        v, d = shingle_hashes(h, offs, words)
        first = np.searchsorted(d, np.arange(b - a + 1))
        out += [v[first[i] : min(first[i + 1], first[i] + k)].copy() for i in range(b - a)]
    return out


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:k] if parts else np.empty(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness: of the k smallest hashes of the union, the share in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = np.concatenate([both[1:] == both[:-1], [False]])
    new = np.concatenate([[True], both[1:] != both[:-1]])
    return float(twice[new][:k].mean())


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    union = distinct_count(merge([a, b], k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_count(a, k))


def to_text(a: np.ndarray, k: int = K, words: int = WORDS) -> str:
    return f"bk{k}.{words}:" + base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s.partition(":")[2]), "<u8")


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K, words: int = WORDS) -> DataFrame:
    """df with a fingerprint column; an existing column of that name is replaced."""

    @F.pandas_udf("string")
    def make(s: pd.Series) -> pd.Series:
        return pd.Series([to_text(x, k, words) for x in sketches([(t or "").encode() for t in s], k, words)], dtype=object)

    ship(df.sparkSession)
    return df.withColumn(out, make(F.col(text)))


def merge_by(df: DataFrame, key: str, sketch: str = "fingerprint", k: int = K) -> DataFrame:
    """(key, fingerprint) of each key's whole group: runs of a key are merged as they stream by, first in salted
    parts, then the parts; no group is held. Null keys form a group; null sketches count as empty."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have, some, schema = None, np.empty(0, np.uint64), False, None
        for batch in batches:
            schema = batch.schema
            for value, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if some and value != now:
                    yield pa.record_batch([pa.array([now], schema.field(0).type), pa.array([to_text(have, k)], schema.field(1).type)], schema=schema)
                    have = np.empty(0, np.uint64)
                now, some = value, True
                have = merge([have, from_text(s or "")], k)
        if some:
            yield pa.record_batch([pa.array([now], schema.field(0).type), pa.array([to_text(have, k)], schema.field(1).type)], schema=schema)

    ship(df.sparkSession)
    two = df.select(F.col(key).alias("key"), F.col(sketch).alias("fingerprint"))
    parts = two.repartition(F.col("key"), F.pmod(F.xxhash64("fingerprint"), F.lit(64))).sortWithinPartitions("key").mapInArrow(fold, two.schema)
    return parts.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(fold, two.schema).withColumnRenamed("key", key)


def _starts(ids: DataFrame, parts: int) -> np.ndarray:
    """Exact first keys of about `parts` runs of equal row counts. Only ids are read; the driver gets `parts` numbers."""
    cuts = ids.agg(F.percentile_approx("k", [i / parts for i in range(parts)], 10_000).alias("q")).first()["q"]
    if not cuts:
        return np.empty(0, np.int64)
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, s.to_numpy(np.int64), "right"))

    firsts = ids.groupBy(run("k").alias("r")).agg(F.min("k").alias("k")).collect()
    return np.unique(np.array([r["k"] for r in firsts], np.int64))


FOLLOWED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles_est double, contained_in_edited double"


def with_next(spark: SparkSession, docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprint every text and its edited text, whose last quarter is taken from the start of the next
    document by ascending doc_id (after the last: the first).

    The rows are dealt once, into runs of consecutive ids; each run also gets the first row of the next run, so
    no global window is needed. Rows with equal doc_id follow one another by text; null ids come last.
    """
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = _starts(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("k")), min(4 * width, 1 << 16))
    n = max(1, len(starts))

    @F.pandas_udf("array<int>")
    def runs(s: pd.Series) -> pd.Series:
        x = s.to_numpy(np.int64)
        r = np.searchsorted(starts, x, "right") - 1
        first = starts[r] == x
        return pd.Series([[a, -1 - (a - 1) % n] if f else [a] for a, f in zip(r.tolist(), first.tolist(), strict=True)], dtype=object)

    dealt = rows.withColumn("r", F.explode(runs(key))).select(
        F.when(F.col("r") < 0, -1 - F.col("r")).otherwise(F.col("r")).alias("run"), (F.col("r") < 0).alias("guard"), "doc_id", "text"
    )
    dealt = dealt.repartition(width, "run").sortWithinPartitions("run", "guard", F.col("doc_id").asc_nulls_last(), "text")
    return dealt.mapInArrow(lambda it: _follow(it, k, words), FOLLOWED)


def _follow(batches: Iterator[pa.RecordBatch], k: int, words: int) -> Iterator[pa.RecordBatch]:
    """Rows of runs in order; a run ends with its guards, of which the first counts."""
    held: list[tuple[int | None, str]] = []  # the last one still waits for its next
    size, closed = 0, None
    for batch in batches:
        for run, guard, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if guard:
                if closed != run:
                    yield _edited([*held, (doc, text)], k, words)
                    held, size, closed = [], 0, run
                continue
            held.append((doc, text))
            size += len(text)
            if size > 1 << 20 and len(held) > 1:
                yield _edited(held, k, words)
                held, size = held[-1:], len(text)


def _edited(rows: list[tuple[int | None, str]], k: int, words: int) -> pa.RecordBatch:
    """Results for all rows but the last, which is only the next of the one before."""
    texts = [t for _, t in rows]
    new = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for t, after in zip(texts, texts[1:], strict=False)]
    own, other = sketches([t.encode() for t in texts], k, words), sketches([t.encode() for t in new], k, words)
    n = len(new)
    return pa.record_batch(
        {
            "doc_id": pa.array([d for d, _ in rows[:n]], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
            "fingerprint": pa.array([to_text(x, k, words) for x in own[:n]], pa.string()),
            "edited_fingerprint": pa.array([to_text(x, k, words) for x in other], pa.string()),
            "near_edited": pa.array([resemblance(a, b, k) for a, b in zip(own, other, strict=False)], pa.float64()),
            "near_next": pa.array([resemblance(a, b, k) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
            "n_shingles_est": pa.array([distinct_count(x, k) for x in own[:n]], pa.float64()),
            "contained_in_edited": pa.array([containment(a, b, k) for a, b in zip(own, other, strict=False)], pa.float64()),
        }
    )
