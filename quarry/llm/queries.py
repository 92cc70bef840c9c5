"""The ten operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, fingerprint, htmltext, langid, neardup, packing, pii, quality, tokenbin, warc


#: For the synthetic tables, where a session names no key.
TEST_KEY = "synthetic tables"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(spark, _table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_bits", "base_failed", "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.fit(spark, docs.where("NOT held_out"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(_table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(spark, made)


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(spark, _table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymized(_table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii.key_of(spark, TEST_KEY))
    return made.select("doc_id", "text", F.size("pii_kinds").alias("n_replaced"), F.array_join("pii_kinds", ",").alias("kinds"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_fingerprint, op2_byte_bpe, op3_quality_rules, op4_language_id, op5_html_text, op6_best_fit_packing, op7_minhash_neardup, op8_pii_pseudonyms, op9_warc, op10_simple8b_tokens]
    return {f.__name__: f for f in made}


_WORD = r"[^\x20\x09-\x0D]"

OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN pos USING (r)),
b AS (
  SELECT *, (CASE WHEN {quality.RULES[0][1]} THEN 1 ELSE 0 END{"".join(f" + CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, (_, c) in list(enumerate(quality.RULES))[1:])})::BIGINT AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits,
       (failed_bits & {quality.mask("base")}) <> 0 AS base_failed, (failed_bits & {quality.mask("base") | quality.mask(quality.POLICY)}) = 0 AS kept
FROM b
"""

OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 85 * (na.n_shingles + nb.n_shingles - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS v, doc_id AS o FROM n UNION SELECT reach.v, e.b FROM reach JOIN e ON reach.o = e.a)
SELECT n.doc_id, n_shingles, min(o) AS component_id, n.doc_id = min(o) AS kept FROM n JOIN reach ON n.doc_id = v GROUP BY n.doc_id, n_shingles
"""

OP9_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT *, sha1(h) AS x, max(page_id) OVER (PARTITION BY sha1(h)) AS top, row_number() OVER (PARTITION BY page_id, sha1(h) ORDER BY url) AS k FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = top AND k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top AND k = 1 THEN NULL ELSE top END AS refers_to
FROM d
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op7_minhash_neardup": OP7_SQL, "op9_warc": OP9_SQL}
