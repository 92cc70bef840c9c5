"""A training-corpus pipeline: language, quality, near-duplicates, pseudonyms, packing.

Each stage takes all that its predecessor kept, as a table written in the shared folder. Stages but the last return the
columns of documents; others that the table may have are left out. Null texts and texts without a letter go in the first
stage; rows with null doc_id are never grouped, and all stay. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm import langid, neardup, packing, pii, quality
from quarry.session import materialize

#: For the synthetic tables, where the session names no key (conf quarry.pii.key).
TEST_KEY = "synthetic tables"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without a letter go. Learns from labelled documents that aren't held out."""
    model = langid.fit(spark, docs.where(~langid.held_out()))
    return langid.predict(docs.select(COLUMNS), model).where(F.col("lang_pred") != langid.UND).select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps."""
    return quality.judged(docs.select(COLUMNS)).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), and one of equal rows."""
    kept = neardup.groups(spark, docs, words=5, percent=80).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("k"))
    rows = docs.select(COLUMNS).join(kept, F.col("doc_id") == F.col("k"), "left_semi")
    once = F.row_number().over(W.partitionBy("doc_id", F.xxhash64("text")).orderBy("source", "lang"))
    known = rows.where("doc_id IS NOT NULL").withColumn("__n", once).where("__n = 1").select(COLUMNS)
    return known.unionByName(docs.select(COLUMNS).where("doc_id IS NULL"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values replaced; n_chars follows the new text."""
    made = pii.pseudonymized(docs.select(COLUMNS), key=pii.key_of(spark, TEST_KEY))
    return made.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(spark, packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language", language), ("quality", quality_rules), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("packing", pack)]
#: SQL can't express the first and last stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(spark, docs, f"stage-{name}")
    return docs
