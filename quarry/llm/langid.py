"""Language identification with hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1 and -1. A letter trigram's vector binds
the three letters' vectors, the first rotated twice, the second once; a text bundles (adds) the vectors of its
trigrams; a language's prototype bundles those of a sample of its labelled texts, less what all languages share.
A text gets the language whose prototype has the greatest cosine with it (ties: the alphabetically first);
the score is that cosine, cut to 0..1.

Null texts and texts without a letter are "und" with score 0. Unlabelled rows (null lang) are never learned
from. Without any labelled row everything is "und". Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import by_size, fresh, slices
from quarry.session import ship

DIM = 1024
#: Labelled rows learned from, for each language, about; chosen by a hash of doc_id and text.
SAMPLE = 4000
#: Characters of one text learned from or compared at a time.
PIECE = 1 << 20
#: Rows of trigram vectors that a worker keeps.
KEEP = 20_000
UND = "und"

_ALPHA: list[np.ndarray] = []
_LETTERS: dict[int, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def _letter(cp: int) -> np.ndarray:
    if cp not in _LETTERS:
        _LETTERS[cp] = (np.random.Generator(np.random.PCG64([7, cp])).integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.float32)
    return _LETTERS[cp]


def _vector(code: int) -> np.ndarray:
    a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
    return np.roll(_letter(a), 2) * np.roll(_letter(b), 1) * _letter(c)


class Vectors:
    """Vectors of trigrams, kept by code up to KEEP rows."""

    def __init__(self) -> None:
        self.row: dict[int, int] = {}
        self.table = np.empty((0, DIM), np.float32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        codes = codes.tolist()
        new = [c for c in codes if c not in self.row]
        if new:
            if len(self.row) + len(new) > KEEP:
                self.row, self.table, new = {}, np.empty((0, DIM), np.float32), codes
            if len(new) > KEEP:
                return np.array([_vector(c) for c in codes], np.float32)
            for c in new:
                self.row[c] = len(self.row)
            self.table = np.concatenate([self.table, np.array([_vector(c) for c in new], np.float32)])
        return self.table[[self.row[c] for c in codes]]


_KEPT = Vectors()


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the letter trigrams of a text; runs of other characters count as one gap."""
    parts, low = [], text.lower()
    x = np.array([32], np.int64)
    for at in range(0, max(1, len(low)), PIECE):
        cps = np.frombuffer(low[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        # The last two characters of a piece stay for the next one's first trigrams.
        x = np.concatenate([x[-2:], np.where(_is_letter()[cps], cps, 32), [32] if at + PIECE >= len(low) else []]).astype(np.int64)
        x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
        if len(x) >= 3:
            parts.append(np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:], return_counts=True))
    if len(parts) < 2:
        return parts[0] if parts else (np.empty(0, np.int64), np.empty(0, np.int64))
    codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def bundle(texts: list[str]) -> np.ndarray:
    """The bundled trigram vectors of each text. Common trigrams are multiplied as one matrix."""
    out = np.zeros((len(texts), DIM), np.float32)
    for a, b in by_size(texts, 1 << 17):
        each = [trigrams(t) for t in texts[a:b]]
        codes, back = np.unique(np.concatenate([c for c, _ in each]), return_inverse=True)
        doc = np.repeat(np.arange(b - a), [len(c) for c, _ in each])
        weights = np.concatenate([n for _, n in each]).astype(np.float32)
        for k in range(0, len(codes), 4096):
            own = (back >= k) & (back < k + 4096)
            counts = np.zeros((b - a, min(4096, len(codes) - k)), np.float32)
            counts[doc[own], back[own] - k] = weights[own]
            out[a:b] += counts @ _KEPT.of(codes[k : k + 4096])
    return out


def fit(spark: SparkSession, labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and unit prototypes from (doc_id, text, lang); about `sample` rows for each language at most. The driver gets
    a vector for each language."""
    ship(spark)
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, DIM), np.float32)
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    part = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for part in slices([b], "text", 1 << 20):
                v = bundle(part.column("text").to_pylist())
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(size > 0, size, 1)
                for lang, x in zip(part.column("lang").to_pylist(), v.astype(np.float64), strict=True):
                    total[lang] = total.get(lang, 0) + x
        if total:
            yield pa.record_batch({"lang": pa.array(list(total)), "part": pa.array([TaskContext.get().partitionId()] * len(total), pa.int32()), "v": pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        # Sums of floats in the order of the partitions, so that equal runs give equal scores.
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "part": [int(pdf["part"].min())], "v": [np.sum(np.stack(pdf.sort_values("part")["v"].to_list()), axis=0)]})

    schema = "lang string, part int, v array<double>"
    some = part.mapInArrow(sums, schema).groupBy("lang", F.col("part") % 64).applyInPandas(add, schema)
    got = sorted((r["lang"], r["v"]) for r in some.groupBy("lang").applyInPandas(add, schema).collect())
    names = [k for k, _ in got]
    protos = np.array([v for _, v in got])
    protos /= np.linalg.norm(protos, axis=1, keepdims=True)
    if len(names) > 1:
        protos = protos - protos.mean(axis=0)
        protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)
    return names, protos.astype(np.float32)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """df with lang_pred and score; existing columns of those names are replaced."""
    ship(df.sparkSession)
    names, protos = model

    def best(texts: list[str]) -> tuple[list[str], np.ndarray]:
        v = bundle(texts)
        size = np.linalg.norm(v, axis=1)
        cos = (v @ protos.T) / np.where(size > 0, size, 1)[:, None] if names else np.zeros((len(texts), 1))
        top = cos.argmax(axis=1)
        known = (size > 0) & bool(names)
        return [names[t] if k else UND for t, k in zip(top.tolist(), known.tolist(), strict=True)], np.where(known, np.clip(cos[np.arange(len(texts)), top], 0, 1), 0.0).astype(float)

    @F.pandas_udf("lang_pred string, score double")
    def run(s: pd.Series) -> pd.DataFrame:
        parts = [best(["" if t is None else t for t in s.iloc[k : k + 500]]) for k in range(0, len(s), 500)]
        return pd.DataFrame({"lang_pred": [x for names_, _ in parts for x in names_], "score": np.concatenate([p for _, p in parts]) if parts else []})

    both = fresh(df.columns, "__lang")
    made = df.withColumn(both, run(F.col(text)))
    return made.withColumns({"lang_pred": F.col(both)["lang_pred"], "score": F.col(both)["score"]}).drop(both)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the checksum of the id as text leaves 1 on division by 3; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
