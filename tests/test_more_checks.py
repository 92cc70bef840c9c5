"""Checks of lines in their surroundings, checks across files, other languages, records and streams."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import corpus_checks, fact_checks, graph, report, text_checks
from quarry.plans import audit
from quarry.sources import other_languages, python_facts, records, tables, user_gates
from quarry.streaming import watch


def files(spark, tree):
    return spark.createDataFrame(list(tree.items()), "path string, text string")


def hits(df):
    return {(r.check_id, r.path, r.line_no) for r in df.collect()}


def test_surroundings(spark):
    tree = {
        "a.py": "log.info('it crashed with error')\nlogger.error('server ready now')\nlog.debug('failed to open it, error')\nx = 4711\nLIMIT = 4711\nr = requests.get(u)\nr2 = requests.get(u)\nif r2.status_code != 200:\n    pass\n",
        "b.py": "def a_b(): pass\ndef c_d(): pass\ndef eF(): pass\ndef gH(): pass\n# x = 1\n# if x:\n# foo(x)\ntry:\n    pass\nexcept Exception as e:\n    log.error('bad thing')\n    log.error('bad %s', e)\nf = open('x')\n",
        "requirements.txt": "foo\nbar>=1\nbaz==1.0\n",
        "c.py": "# TODO: migrate this\n",
        "x_js.py": 'A = "a\\nb"\n',
        "m.go": "f, err := os.Open(p)\ndefer f.Close()\n\n\n\n\n\ng, err := os.Open(q)\n",
    }
    got = hits(text_checks.all_checks(tables.lines(files(spark, tree))))
    want = {
        ("log_level_scan", "a.py", 1), ("log_level_scan", "a.py", 2), ("magic_number_scan", "a.py", 4), ("naming_scan", "b.py", 1), ("commented_code_scan", "b.py", 5), ("log_context_scan", "b.py", 11), ("resource_leak_scan", "b.py", 13),
        ("unpinned_dep_scan", "requirements.txt", 1), ("unpinned_dep_scan", "requirements.txt", 2), ("stale_migration_marker", "c.py", 1), ("embedded_string.unescaped_newline", "x_js.py", 1), ("resource_leak_scan", "m.go", 8),
    }
    assert want <= got and ("response_status_scan", "a.py", 7) not in got and not {("log_context_scan", "b.py", 12), ("resource_leak_scan", "m.go", 1), ("log_level_scan", "a.py", 3), ("magic_number_scan", "a.py", 5)} & got


def test_encodings(spark):
    raw = spark.createDataFrame([("bom", bytearray(b"\xef\xbb\xbfa")), ("bad", bytearray(b"\xff\xfe")), ("mix", bytearray(b"a\r\nb\nc")), ("cr", bytearray(b"a\rb")), ("nul", bytearray(b"a\0")), ("ok", bytearray("é\n".encode()))], "path string, content binary")
    assert {(r.path, r.detail) for r in text_checks.encodings(raw).collect()} == {("bom", "BOM"), ("bad", "invalid UTF-8"), ("mix", "mixed line ends"), ("cr", "bare CR"), ("nul", "NUL")}


def test_across_files(spark):
    long = "x = 1\n" * 60
    flow = "import subprocess, json\ndef build_a(): pass\ndef run_b(): pass\njson.loads(x)\n"
    tree = {
        "p/a_handlers.py": "", "p/b_handlers.py": "", "p/c_handlers.py": "", "p/x_checks.py": "", "p/y_checks.py": "", "p/z_checks.py": "", "p/utils.py": long, "q/utils.py": long, "p/helpers.py": "y", "p/n.py": "y", "p/n_v2.py": "y",
        "q/shim.py": "from p import n\n", "r/api.py": "@app.post('/x')\n", "p/call_service.py": flow, "q/save_client.py": flow, "q/one_adapter.py": flow + "import call_service\nimport save_client\n", "q/far_engine.py": "def run_b(): pass\n",
    }
    f = files(spark, tree).withColumn("size", F.length("text").cast("long"))
    lines = tables.lines(f)
    assert hits(corpus_checks.proliferation(f)) == {("c52.responsibility_proliferation", "p/a_handlers.py", 1), ("c52.responsibility_proliferation", "p/x_checks.py", 1)}
    assert hits(corpus_checks.forked(f)) == {("c52.generic_shared_fork", "p/utils.py", 1), ("c52.generic_shared_fork", "q/utils.py", 1)}
    assert hits(corpus_checks.bypassed(f, lines)) == {("c52.abstraction_bypass", "p/utils.py", 1), ("c52.abstraction_bypass", "q/utils.py", 1)}
    flows = {r.path: r.detail for r in corpus_checks.parallel_flows(f, lines).collect()}
    assert flows == {"p/call_service.py": "1 partners, near q/save_client.py", "q/save_client.py": "1 partners, near p/call_service.py"}
    assert hits(corpus_checks.copies(f)) == {("file_proliferation.clone_naming", "p/n_v2.py", 1), ("file_proliferation.shadow_file", "p/utils.py", 1), ("file_proliferation.shadow_file", "q/utils.py", 1), ("file_proliferation.generic_helper", "p/utils.py", 1), ("file_proliferation.generic_helper", "p/helpers.py", 1)}
    assert hits(corpus_checks.copies(f, f.where("path = 'p/n_v2.py'"))) == {("file_proliferation.clone_naming", "p/n_v2.py", 1)}
    assert hits(corpus_checks.unused_shims(python_facts.facts(f))) == {("unused_shim_module", "q/shim.py", 1)}
    assert hits(corpus_checks.fallbacks(f, ["BUILD_A"], ["q/"]).where("severity = 'HIGH'")) == {("fallback.pattern", "q/save_client.py", 1), ("fallback.pattern", "q/one_adapter.py", 1)}
    owned = corpus_checks.config_owners(f, python_facts.facts(f), {"json.loads": ["p/call_service.py"]}, [])
    assert hits(owned) == {("config_ssot.literal_owner", "q/save_client.py", 1), ("config_ssot.literal_owner", "q/one_adapter.py", 1)}
    gone = spark.createDataFrame([("p",)], "module string")
    assert hits(corpus_checks.broken_imports(lines, gone)) == {("import_integrity.broken_import", "q/shim.py", 1)}
    b = spark.createDataFrame([(["p/n.py", "p/*_v2.py"],)], "allowed_files array<string>")
    assert hits(corpus_checks.outside_boundaries(f.where("path LIKE 'p/n%' OR path = 'q/utils.py'").select("path"), b)) == {("boundary_breach.file_outside_all_boundaries", "q/utils.py", 1)}


def test_http_and_scripts(spark):
    tree = {"r/api.py": "@app.post('/x')\ndef f(): return {'user_name': 1}\n", "r/f.js": "fetch('/x')\nfetch('/x', {method: 'POST'})\nshow(data.user_name, data.lost_field)\n"}
    lines = tables.lines(files(spark, tree))
    got = hits(corpus_checks.response_shapes(lines))
    assert got == {("response_shape_scan", "r/f.js", 3)}
    own = corpus_checks.own_literals(tables.lines(files(spark, {"a.py": "def generic_x():\n    return 'my_repo/a'\nos.environ.get('MINE_X')\n# my_repo/\n"})), ["my_repo/"], "MINE_")
    assert hits(own) == {("implementation_overfit.hardcoded_repo_path", "a.py", 2), ("implementation_overfit.fake_generic_helper", "a.py", 2), ("implementation_overfit.env_tight_coupling", "a.py", 3)}


def test_other_languages(spark):
    tree = {
        "a/x.ts": "import {\n  y,\n  w\n} from './y'\nimport z from '@/b/z'\n// import q from './gone'\nexport class A {}\nconst OUT = 'out.txt';\nfs.writeFileSync(OUT, s)\nfs.writeFile(path.join('d', 'e.txt'), s)\nexport interface P { a: string; b?: number }\nprocess.env.API_URL\nprisma.user.create({})\n",
        "a/y.tsx": "const q = require('../b')\n", "b/z/index.ts": "", "b/index.js": "",
        "m.go": 'package m\nimport (\n  "fmt"\n  "os"\n)\ntype T struct {\n  A int\n  B string\n}\nfunc Run() {\n  os.WriteFile("f.txt", b, 0)\n  go work()\n}\nfunc init() {}\n', "J.java": 'import a.b.C;\npublic class J { void f() { Files.write(Path.of("d", "o"), x); } }\nrecord R(int a, String b) {}\n',
        "S.swift": "import UIKit\nstruct S {\n  var a: Int\n}\nlet a = b!.c\nvar d: String!\nlet e = \"no!\"\n",
    }
    f = files(spark, tree)
    all_ = other_languages.facts(f)
    got = {(r.path, r.fact, r.name) for r in all_.collect()}
    want = {
        ("a/x.ts", "import", "./y"), ("a/x.ts", "import", "@/b/z"), ("a/x.ts", "symbol", "A"), ("a/x.ts", "write", "out.txt"), ("a/x.ts", "write", "d/e.txt"), ("a/x.ts", "contract", "P"), ("a/x.ts", "env", "API_URL"), ("a/x.ts", "write", "prisma:user"), ("a/y.tsx", "import", "../b"),
        ("m.go", "import", "fmt"), ("m.go", "import", "os"), ("m.go", "symbol", "Run"), ("m.go", "write", "f.txt"), ("m.go", "contract", "T"), ("J.java", "import", "a.b.C"), ("J.java", "symbol", "J"), ("J.java", "write", "d/o"), ("J.java", "contract", "R"), ("S.swift", "import", "UIKit"), ("S.swift", "contract", "S"),
    }
    assert want <= got and ("a/x.ts", "import", "./gone") not in got
    fields = {r.name: r["items"] for r in all_.where("fact = 'contract'").collect()}
    assert fields["P"][0].startswith("a:") and fields["T"] == ["A:int", "B:string"] and fields["R"] == ["a:int", "b:String"]
    edges = other_languages.resolve_relative(all_.where("fact = 'import'"), f)
    assert {(r.src, r.dst) for r in edges.collect()} == {("a/x.ts", "a/y.tsx"), ("a/x.ts", "b/z/index.ts"), ("a/y.tsx", "b/index.js")}
    assert hits(other_languages.swift_checks(tables.lines(f))) == {("swift.force_unwrap", "S.swift", 5), ("swift.implicitly_unwrapped_optional", "S.swift", 6)}


def test_brackets():
    assert other_languages.brace_imbalance("f('}') // }\n/* ( */ g()") is None
    assert other_languages.brace_imbalance("f(\ng]") == (2, "unmatched ]") and other_languages.brace_imbalance("{\n(\n)") == (1, "unclosed {")


def test_versions(spark):
    before = python_facts.facts(files(spark, {"a.py": "def read_x():\n    return 1\n", "p/__init__.py": "import b\nimport a\nimport c\n", "new.py": "x = 1\n"}))
    now = python_facts.facts(files(spark, {"a.py": "def read_x():\n    return 1\ndef write_x():\n    return 2\n", "p/__init__.py": "import a\nimport b\n", "other.py": "def save_y():\n    return 1\n"}))
    assert hits(fact_checks.new_writers(now, before)) == {("illegal_authority_writer.new_writer_in_readonly_module", "a.py", 3)}
    assert hits(fact_checks.import_order(now, before)) == {("init_order_regression.import_order_changed", "p/__init__.py", 1)}


def test_same_functions(spark):
    body = "def f(a):\n    x = a + 1\n    y = x * a\n    return y\n"
    f = python_facts.facts(files(spark, {"a.py": body, "b.py": body.replace("a", "z").replace("f(", "g("), "c.py": body.replace("+", "-"), "d.py": body}))
    assert hits(fact_checks.same_functions(f)) == {("duplication.normalized_function", p, 1) for p in ("a.py", "b.py", "d.py")}
    got = hits(fact_checks.same_functions(f, spark.createDataFrame([("b.py",), ("d.py",), ("c.py",)], "path string")))
    assert got == {("duplication.normalized_function", "b.py", 1), ("duplication.normalized_function", "d.py", 1), ("duplication.cross_touched_duplicate", "b.py", 1), ("duplication.cross_touched_duplicate", "d.py", 1)}


def test_deep_trees_and_prefixes():
    deep = "a = " + "+".join(["1"] * 3000)
    assert python_facts.extract("a.py", deep)[0][1] == "assign"
    assert python_facts.extract("a.py", "x" + ".a()" * 1200)[0][1] == "call"
    assert python_facts.extract("a.py", "a = " + "-" * 100_000 + "1")[0][1] == "too_deep"
    late = "cur.execute('" + "x" * 400 + " select a from t where b = ' + c)"
    assert next(r for r in python_facts.extract("a.py", late) if r[1] == "call")[6]["sql"] == "True"


def test_scopes_of_names():
    text = "def f():\n    p = 'a.txt'\n    open(p, 'w')\ndef g(p):\n    open(p, 'w')\n"
    assert [r[4] for r in python_facts.extract("a.py", text) if r[1] == "write"] == ["a.txt", ""]


def test_user_gates(spark):
    good = "import re\ndef run_check(path, content):\n    return [(n, 'found') for n, x in enumerate(content.split('\\n'), 1) if re.search('bad', x)]\n"
    gates = {"good": good, "evil": "import os\ndef run_check(path, content):\n    return []\n", "sly": "def run_check(path, content):\n    return ().__class__\n", "broken": "def run_check(path, content):\n    return 1 / 0\n"}
    assert {n for n, bad in user_gates.inventory(gates) if bad} == {"evil", "sly"}
    got = user_gates.run(files(spark, {"a.py": "ok\nbad\n", "b.py": "bad\n" * 30}), gates).collect()
    assert sum(r.check_id == "good" for r in got) == 20 and ("good", "a.py", 2) in {(r.check_id, r.path, r.line_no) for r in got} and {r.path for r in got if r.check_id == "internal_failure.broken"} == {"a.py", "b.py"}


def test_gates_and_settings(spark):
    assert audit.profile(None)[0]["file_warn"] == 750 and audit.profile('{"file_warn": 5}')[0]["file_revise"] == 800 and audit.profile("[")[1]
    assert audit.disabled_gates('{"disabled": ["size"]}') == ({"size"}, []) and audit.disabled_gates('{"off": 1}')[0] == set() and audit.disabled_gates('{"off": 1}')[1]
    state = dict(audit.resolve_gates(["size", "god_object_zones"], {"size"}))
    assert state["size"] == "disabled" and state["god_object_zones"] == "run" and state["lines"] == "not_in_filter" and state["encoding_scan"] == "no_input" and dict(audit.resolve_gates())["god_object_zones"] == "opt_in"
    f = files(spark, {"a.py": "password = 'hunter2hunter2'\n" * 12})
    found = audit.run_audit(spark, f, gates=["size", "lines"], settings='{"file_warn": 5, "file_revise": 10}', disabled="oops")
    got = {r.check_id for r in found.collect()}
    assert {"size.file_too_large", "secrets_scan", "meta.malformed_settings"} <= got and audit.exit_code(found) == 1


def test_a_gate_that_fails_is_a_finding(spark, monkeypatch):
    monkeypatch.setitem(audit.GATES, "size", (lambda c: c.files.select("no_such_column"), ""))
    got = {r.check_id for r in audit.run_audit(spark, files(spark, {"a.py": "# TODO x\n"}), gates=["size", "lines"]).collect()}
    assert got == {"internal_failure.size", "todo_scan"}


def test_served_views(spark):
    f = spark.createDataFrame([("a.x", "p", i, "d", s) for i, s in enumerate(["HIGH", "LOW", "CRITICAL", "INFO"])], "check_id string, path string, line_no int, detail string, severity string")
    assert tuple(report.audit_summary(f).first()) == (4, 2, 0, 2)
    rows, meta = report.filtered(f, most=2)
    assert [r.severity for r in rows.collect()] == ["CRITICAL", "HIGH"] and tuple(meta.first()) == (4, True)
    page = report.page(spark.createDataFrame([("m", "abcdefgh")], "name string, text string"), 1, 3).first()
    assert tuple(page) == ("m", "def", 8, 3, True)
    red = report.redacted(spark.createDataFrame([("api_key", "x"), ("note", "y" * 300), ("v", "ghp_abc")], "k string, v string"), "k", "v").collect()
    assert red[0].v == "***" and len(red[1].v) == 203 and red[2].v == "***"
    a = spark.createDataFrame([(1, "t1")], "x int, generated_at string")
    assert report.same_map(a, spark.createDataFrame([(1, "t2")], "x int, generated_at string")) and not report.same_map(a, spark.createDataFrame([(2, "t1")], "x int, generated_at string"))
    lines = spark.createDataFrame([("p", 3, "# noqa: a")], "path string, line_no int, line string")
    assert report.suppressed(f.withColumn("line_no", F.lit(0)), lines).count() == 0


def test_sources(spark):
    f = files(spark, {"src/pkg/__init__.py": "", "app/__init__.py": "", "a.py": "import winreg\n", "b.py": "import winreg\n", "g.py": "# @generated\n"})
    assert {r.root for r in tables.package_roots(f).collect()} == {"pkg", "app"}
    assert [tuple(r) for r in tables.deployment(f).collect()] == [("windows", 2)] and [r.path for r in tables.generated(f).collect()] == ["g.py"]
    s = {r.path: (r.exists, r.size) for r in tables.snapshots(f, spark.createDataFrame([("a.py",), ("z.py",)], "path string")).collect()}
    assert s == {"a.py": (True, 14), "z.py": (False, 0)}


def test_components_of_a_long_ring(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 1000}") for i in range(1000)] + [("x", "n0"), ("n5", "y")]
    got = {r.node: r.component for r in graph.components(spark, spark.createDataFrame(ring, "src string, dst string")).collect()}
    assert len(got) == 1000 and len(set(got.values())) == 1


def test_records(spark, tmp_path):
    n = spark.createDataFrame([("3\t4\ta.py",), ("-\t-\tb.png",), ("1\t0\ta.py",), ("commit x",)], "value string")
    assert [tuple(r) for r in records.churn(n).collect()] == [("a.py", 4, 4)]
    records.write_maps({"m": n}, str(tmp_path))
    assert records.read_map(spark, str(tmp_path), "m", "value string").count() == 4 and records.index({"m": n}).first().n == 4
    assert [r.path for r in records.corrupt(spark.createDataFrame([("a.json", "{"), ("b.json", "{}")], "path string, text string")).collect()] == ["a.json"]
    v = corpus_checks.vulnerabilities(spark.createDataFrame([('{"dependencies": [{"name": "x", "version": "1", "vulns": [{"id": "V-1", "fix_versions": ["2"]}]}]}',)], "json string"))
    assert tuple(v.first()) == ("x", "1", "V-1", "2")


def test_stream(spark, tmp_path):
    files(spark, {"a.py": "password = 'hunter2hunter2'\n"}).write.parquet(f"{tmp_path}/in")
    seen = []
    q = watch.start(watch.versions(spark, f"{tmp_path}/in"), lambda df, n: seen.extend(watch.findings(df).collect()), f"{tmp_path}/at")
    q.awaitTermination(60)
    assert [r.check_id for r in seen] == ["secrets_scan"]
