"""Checks and maps over a small tree of our own."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import corpus_checks, fact_checks, graph, report
from quarry.plans import audit, maps
from quarry.sources import python_facts, tables

TREE = {
    "app/__init__.py": "",
    "app/a.py": "import os\nimport sys\nfrom app import b\nfrom app.c import C\n\n\ndef main():\n    print(b.go(), os.environ['DB_TOKEN'])\n\n\nif __name__ == '__main__':\n    main()\n",
    "app/b.py": "from . import a\nfrom app.c import C\nSTATE = 'data/state.json'\n\n\ndef go(x=[]):\n    open(STATE, 'w').write('x')\n    return a\n",
    "app/c.py": "from dataclasses import dataclass\nfrom app import a\n\n\n@dataclass\nclass C:\n    x: int\n    y: str = ''\n",
    "lib/c.py": "from dataclasses import dataclass\n\n\n@dataclass\nclass C:\n    x: str\n    z: int\n",
    "lib/w.py": "from pathlib import Path\nfrom app.c import C\nfrom app.a import main\nT = Path('data', 'state.json')\n\n\ndef save():\n    T.write_text('y')\n    C(1)\n\n\ndef _gone():\n    return 1\n",
    "lib/x.py": "import app.a\nimport app.b\n__all__ = ['nothing']\nDEBUG_MODE = False\ndebug = True\n\n\nasync def work():\n    return 1\n\n\nasync def other():\n    work()\n    if DEBUG_MODE:\n        return 2\n    raise ValueError()\n    return 3\n",
    "lib/bad.py": "def f(:\n",
    "lib/h.py": "import subprocess, random, logging\n\n\ndef f(df, cur, n):\n    try:\n        subprocess.run(f'rm {n}', shell=True, text=True)\n    except:\n        pass\n    try:\n        cur.execute('SELECT a FROM t WHERE n = ' + n)\n    except Exception:\n        return None\n    try:\n        df.shift(-1)\n    except Exception as e:\n        logging.warning(e)\n        pass\n    try:\n        random.random()\n    except KeyError:\n        pass\n    return eval(n)  # noqa: security_scan\n",
    "tests/test_a.py": "import app.a\n\n\ndef test_one():\n    assert True\n\n\ndef test_two():\n    pass\n",
    "tests/test_none.py": "x = 1\n",
    "lib/s.py": "password = 'hunter2hunter2'\nimport datetime\nnow = datetime.datetime.now()\n# TODO later\npath = '/etc/passwd'\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(TREE.items()), "path string, text string").withColumn("line_count", F.size(tables.split_lines(F.col("text")))).cache()


@pytest.fixture(scope="module")
def facts(files):
    return python_facts.facts(files).cache()


def test_tree_is_read(spark, tmp_path):
    for p, t in TREE.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("x")
    (tmp_path / "bom.py").write_bytes(b"\xef\xbb\xbfimport os\n")
    got = {r.path: r for r in tables.read_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {*TREE, "bom.py"} and got["bom.py"].text == "import os\n" and got["app/a.py"].line_count == 12


def test_checks(files, facts):
    found = {(r.check_id, r.path, r.line_no) for g in fact_checks.groups(facts, tables.lines(files), files).values() for r in g().collect()}
    want = {
        ("broad_except.bare", "lib/h.py", 7), ("broad_except.swallow", "lib/h.py", 7), ("broad_except.hidden_sentinel.bare_or_base", "lib/h.py", 7), ("broad_except.return_none", "lib/h.py", 11),
        ("broad_except.hidden_sentinel.silent_return", "lib/h.py", 11), ("broad_except.log_swallow", "lib/h.py", 15), ("exception_swallow_scan", "lib/h.py", 20), ("security.command_injection", "lib/h.py", 6),
        ("security_scan", "lib/h.py", 10), ("security_scan", "lib/h.py", 22), ("encoding.subprocess_missing_encoding", "lib/h.py", 6), ("reliability.blocking_call_missing_timeout", "lib/h.py", 6),
        ("ml.lookahead_negative_shift", "lib/h.py", 14), ("ml.missing_random_seed", "lib/h.py", 19), ("missing_await_scan", "lib/x.py", 13), ("unreachable_scan", "lib/x.py", 17), ("mutable_default_scan", "app/b.py", 6),
        ("syntax_validity.parse_error", "lib/bad.py", 1), ("unused_import_scan", "app/a.py", 2), ("dead_code_scan", "lib/w.py", 12), ("export_completeness.missing_symbol", "lib/x.py", 3), ("stuck_feature_flag", "lib/x.py", 4),
        ("config.dangerous_default", "lib/x.py", 5), ("config.missing_env_var_check", "app/a.py", 8), ("test_quality.literal_only_asserts", "tests/test_a.py", 4), ("test_quality_scan", "tests/test_a.py", 8), ("empty_test_module", "tests/test_none.py", 1),
        
    }
    assert want - found == set()
    assert not {f for f in found if f[1] == "lib/c.py" and f[0] not in ("unused_import_scan",)}


def test_audit(spark, files):
    found = audit.run_audit(spark, files)
    got = {(r.check_id, r.path, r.line_no) for r in found.collect()}
    assert ("security_scan", "lib/h.py", 22) not in got  # the marker on the line
    assert {("secrets_scan", "lib/s.py", 1), ("timezone_scan", "lib/s.py", 3), ("todo_scan", "lib/s.py", 4), ("hardcoded_path_scan", "lib/s.py", 5)} <= got
    assert {r.severity for r in audit.run_audit(spark, files, severity="HIGH").collect()} == {"HIGH", "CRITICAL"}
    one = found.where("check_id = 'secrets_scan'").first()
    allow = spark.createDataFrame([(one.fingerprint, "lib/s.py", 1, "a good reason", "code", "evidence here", None)], "fingerprint string, file string, line int, reason string, evidence_type string, evidence string, expires_at string")
    left = audit.run_audit(spark, files, allowlist=allow, now="2024-01-01", checks=["secrets_scan"])
    assert left.count() == 0
    with pytest.raises(ValueError, match="too many"):
        audit.run_audit(spark, files, most_files=3)


def test_maps(spark, files):
    seed = [{"authority_domain": "state", "allowed_writers": ["app/b.py"], "target_file_patterns": ["data/*.json"]}]
    churn = spark.createDataFrame([("app/a.py", 100, 20)], "path string, added int, deleted int")
    m = audit.run_maps(spark, files, seed=seed, churn=churn)
    s = {r.file: r for r in m["structural"].collect()}
    assert s["app/a.py"].cycles == ["app/a.py", "app/b.py", "app/c.py"] and "cycle_member" in s["app/b.py"].tags and "unparseable" in s["lib/bad.py"].tags
    assert s["app/a.py"].imports_in == ["app/b.py", "app/c.py", "lib/w.py", "lib/x.py", "tests/test_a.py"]
    a = {(r.writer, r.kind) for r in m["authority"].collect()}
    assert a == {("app/b.py", "canonical_write"), ("lib/w.py", "illegal_write")}
    c = {r.entity: r for r in m["data_contract"].collect()}["C"]
    assert c.canonical_path == "app/c.py" and c.drift_flags == ["annotation:lib/c.py:x", "extra:lib/c.py:z", "missing:lib/c.py:y"] and "lib/w.py" in c.writers
    conf = {(r.domain, r.subject): r.severity for r in m["conflict"].collect()}
    assert conf[("structural_cycle", "app/a.py")] == "high" and conf[("state", "state::lib/w.py")] == "high" and ("contract_drift", "C") in conf and conf[("env_coupling", "app/a.py::main")] == "low"
    hot = {r.target: r for r in m["hotspot"].collect()}
    assert "churn" in hot["app/a.py"].reasons and "test_gap" not in hot["app/a.py"].reasons and "test_gap" in hot["app/b.py"].reasons
    assert m["refactor_boundary"].count() == 1
    f = {(r.category, r.subject): r.severity for r in m["findings"].collect()}
    assert f[("runtime_config_risk", "DB_TOKEN")] == "MEDIUM" and f[("schema_drift_risk", "C")] == "MEDIUM" and f[("write_authority_violation", "state::lib/w.py")] == "HIGH"
    again = audit.run_maps(spark, files.where("path <> 'lib/w.py'"), seed=seed, previous_conflicts=m["conflict"], previous_findings=m["findings"])
    assert {r.subject: r.conflict_status for r in again["conflict"].collect()}["state::lib/w.py"] == "resolved"
    assert {r.subject: r.finding_status for r in again["findings"].collect()}["state::lib/w.py"] == "resolved"
    shared = maps.authority(python_facts.facts(files))
    assert {r.writer for r in shared.where("kind = 'shared_write'").collect()} == {"app/b.py", "lib/w.py"}
    seen = maps.traced(m["runtime"], spark.createDataFrame([("main",)], "name string"))
    assert {r.node: r.status for r in seen.collect()}["app/a.py::main"] == "observed"


def test_versions(spark, files, facts):
    old = dict(TREE) | {"app/c.py": TREE["app/c.py"].replace("y: str = ''", "w: int"), "app/b.py": TREE["app/b.py"].replace("x=[]", "x, k")}
    before = python_facts.facts(spark.createDataFrame(list(old.items()), "path string, text string"))
    got = {(r.check_id, r.detail) for r in fact_checks.against_previous(facts, before).collect()}
    assert got == {("contract_shape_drift.field_removed", "C.w"), ("contract_shape_drift.field_added", "C.y"), ("api.public_function_signature_change", "go: k")}


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "g"), ("f", "h"), ("b", "e")]
    got = {r.node: r.component for r in graph.components(spark, spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "g": "g"}


def test_components_of_long_cycles(spark):
    ring = [(f"{i:03}", f"{(i + 1) % 300:03}") for i in range(300)]
    got = {r.node: r.component for r in graph.components(spark, spark.createDataFrame(ring, "src string, dst string").coalesce(1)).collect()}
    assert got == {f"{i:03}": "000" for i in range(300)}


def test_import_cycles(spark):
    tree = {
        "app/a.py": "import os\nfrom app.b import x\nfrom lib.z import y\n", "app/b.py": "from .c import x\n", "app/c.py": "\nfrom .a import x\nfrom .d import y\n", "app/d.py": "from .d import x\n",
        "lib/z.py": "def f():\n    from app.a import x\n", "lib/w.py": "from app.a import x\n", "top.py": "from .top import x\n", "lib/w.js": "from app.a import x\n", "empty.py": None,
    }
    lines = tables.lines(spark.createDataFrame(list(tree.items()), "path string, text string"))
    got = {(r.path, r.line_no, r.detail, r.severity) for r in corpus_checks.import_cycles(spark, lines).collect()}
    assert got == {("app/a.py", 2, "3 modules: app.a, app.b, app.c", "HIGH"), ("app/d.py", 1, "1 modules: app.d", "HIGH")}
    assert corpus_checks.import_cycles(spark, lines.where("false")).count() == 0


def test_report(spark):
    f = spark.createDataFrame([("a", "p", i, "d", s) for i, s in enumerate(["INFO", "LOW", "HIGH", "HIGH"])], "check_id string, path string, line_no int, detail string, severity string")
    assert report.floor(f, "MEDIUM").count() == 2 and report.capped(f, 2).count() == 2 and [r.line_no for r in report.top(f, 2).collect()] == [2, 3]
    assert report.top_checks(f).first().n == 4
    cache = tables.changed(spark.createDataFrame([("p", "x")], "path string, text string"), spark.createDataFrame([], "content_hash string, version string"), "1")
    assert cache.count() == 1
