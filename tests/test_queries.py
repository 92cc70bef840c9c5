"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import pytest

from quarry import code_queries, map_queries, queries

QUERIES = queries.QUERIES | code_queries.queries() | map_queries.QUERIES
ORACLES = queries.ORACLES | code_queries.oracles() | map_queries.ORACLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(tuple("<null>" if r[i] is None else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = _rows(df.columns, df.collect())
    r = duck.sql(ORACLES[name])
    assert got == _rows(r.columns, r.fetchall())


def test_conflicts_of_a_name_with_very_many_definitions(spark, tmp_path):
    """Every definition is a variant of the map, and each of them but the canonical one a conflict."""
    duckdb = pytest.importorskip("duckdb")
    n, plants = len(code_queries.PLANTS), [code_queries.number("core/ca{id}.py"), code_queries.number("tools/cb{id}.py")]
    ids = [i * n + k for i in range(600) for k in plants]
    sf = str(tmp_path)
    spark.createDataFrame([(i,) for i in ids], "doc_id bigint").write.parquet(f"{sf}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    for name in ("map_conflicts", "map_contracts", "map_contract_drift"):
        df, r = QUERIES[name](spark, sf), duck.sql(ORACLES[name])
        assert _rows(df.columns, df.collect()) == _rows(r.columns, r.fetchall()), name
    m = map_queries._maps(spark, sf)
    paths = sorted(f"{'core/ca' if i % n == plants[0] else 'tools/cb'}{i}.py" for i in ids)
    assert [v.path for v in m["contracts"].first().variants] == paths
    conf = m["conflicts"].where("domain = 'contract_drift'").collect()
    assert [(c.subject, c.files) for c in conf] == [("Order", paths)]
    assert sorted(r.files for r in m["conflicts"].where("domain = 'contract_structural'").collect()) == [[p, paths[0]] for p in paths[1:]]
