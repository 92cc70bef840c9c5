"""The pipeline's stages against the operators' brute-force versions, and the registered queries on the smallest tables."""

import os

import pytest

import corpus_pipeline as cp
from tests.llm.test_operators import SCHEMA, brute_groups, corpus

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    one = cp.language(spark, docs, "")
    kept = {(r.doc_id, r.text) for r in one.collect()}
    assert one.columns == cp.COLUMNS and kept == {(d, t) for d, t, *_ in corpus() if t and any(c.isalpha() for c in t)}
    two = cp.quality_rules(spark, one, "")
    left = [(r.doc_id, r.text) for r in two.collect()]
    assert {d for d, _ in left} >= set(range(100, 108)) and not {203, 204, 206, 207} & {d for d, _ in left}
    three = cp.near_duplicates(spark, two, "")
    groups = brute_groups([x for x in left if x[0] is not None], 5, 80)
    assert sorted(r.doc_id for r in three.where("doc_id IS NOT NULL").collect()) == sorted({c for _, c in groups.values()})
    four = cp.pseudonyms(spark, three, "")
    assert four.count() == three.count() and all(r.n_chars == len(r.text) for r in four.collect())
    assert {r.doc_id for r in cp.pack(spark, four, "").collect()} == {r.doc_id for r in four.collect()}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).select(cp.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_run(spark):
    rows = cp.run(spark, SMALL).collect()
    by = {}
    for r in rows:
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
    assert rows and max(by.values()) <= 1024
