"""Queries over a source tree written from the documents table, with SQL that states what they find.

Every document becomes a file. Its doc_id chooses what the file holds, out of PLANTS, and gives the names in it. Lines of a
plant say what is to be found there ("#! check SEVERITY"); those marks are taken out of the file and put into the SQL, which
joins them with the documents. The operators see only the files. Facts and lines are written once for all queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import report
from quarry.plans import audit
from quarry.session import materialize

#: (path, text); {id} is the doc_id.
PLANTS: list[tuple[str, str]] = [
    ("core/h{id}.py", """
def f(n):
    try:
        return int(n)
    except:  #! broad_except.bare HIGH; broad_except.swallow HIGH; broad_except.hidden_sentinel.bare_or_base MEDIUM; exception_swallow_scan HIGH
        pass
"""),
    ("core/h{id}.py", """
def f(n):
    try:
        return int(n)
    except BaseException as e:  #! broad_except.base_exception HIGH; broad_except.hidden_sentinel.bare_or_base MEDIUM
        n = e
        return n + 1
"""),
    ("core/h{id}.py", """
def f(n):
    try:
        return int(n)
    except Exception:  #! broad_except.return_none MEDIUM; broad_except.hidden_sentinel.silent_return MEDIUM
        return None
"""),
    ("core/h{id}.py", """
def f(n, log):
    try:
        return int(n)
    except Exception as e:  #! broad_except.log_swallow MEDIUM; broad_except.hidden_sentinel.log_swallow MEDIUM
        log.warning(e)
        pass
"""),
    ("core/h{id}.py", """
def f(n, logger):
    try:
        return int(n)
    except Exception as e:  #! broad_catch_scan MEDIUM
        logger.error(e)
"""),
    ("core/h{id}.py", """
def f(n):
    try:
        return int(n)
    except ValueError:  #! exception_swallow_scan MEDIUM
        pass
    try:
        return int(n + 1)
    except KeyboardInterrupt:
        pass
    try:
        return int(n + 2)
    except Exception:
        raise
"""),
    ("core/c{id}.py", """
import subprocess
def f(name):
    subprocess.run(f"rm {name}", shell=True, timeout=3)  #! security.command_injection CRITICAL; security_scan HIGH; boundary_validation_scan HIGH
    subprocess.run(["ls"], text=True, timeout=3)  #! encoding.subprocess_missing_encoding MEDIUM
    subprocess.run(["ls"], text=True, encoding="utf-8", timeout=3)
    subprocess.run(["ls"])  #! reliability.blocking_call_missing_timeout MEDIUM
"""),
    ("core/c{id}.py", """
def f(cur, name, xs):
    cur.execute("a long enough first part of a text that goes on and on, further than any preview of the argument would ever go, so that what decides stands late; it is still going on here, for a good while, past three hundred characters of the argument, as a check by a prefix would look no further than that, and then, SELECT a FROM t WHERE x = " + name)  #! security_scan CRITICAL
    cur.execute("SELECT a FROM t WHERE x = ?", (name,))
    return eval(xs)  #! security_scan HIGH; boundary_validation_scan HIGH
"""),
    ("core/c{id}.py", """
import requests, urllib.request, socket, sqlite3
def f(u):
    requests.options(u)  #! reliability.blocking_call_missing_timeout MEDIUM
    requests.get(u, timeout=5)
    urllib.request.urlopen(u)  #! reliability.blocking_call_missing_timeout MEDIUM
    sqlite3.connect(u)  #! reliability.blocking_call_missing_timeout MEDIUM
    s = socket.socket()  #! resource_leak_scan MEDIUM
    s.connect(u)  #! reliability.blocking_call_missing_timeout MEDIUM
def g(u):
    s = socket.socket()  #! resource_leak_scan MEDIUM
    s.settimeout(3)
    s.connect(u)
"""),
    ("core/l{id}.py", """
def f(df, scaler, train_test_split, x_test, x_train):
    a = df.shift(-1)  #! ml.lookahead_negative_shift HIGH
    b = df.shift(1)
    train_test_split(df)  #! ml.nondeterministic_split MEDIUM
    train_test_split(df, random_state=1)
    scaler.fit(x_test)  #! ml.scaler_fit_on_test HIGH
    scaler.fit(x_train)
    return a, b
"""),
    ("core/l{id}.py", """
import random
def f():
    return random.randint(1, 6)  #! ml.missing_random_seed MEDIUM
"""),
    ("core/l{id}.py", """
import random
def f():
    random.seed(3)
    return random.randint(1, 6)
"""),
    ("core/r{id}.py", """
import atexit
def a(): return 1
atexit.register(a)
atexit.register(a)  #! runtime_duplicate_side_effect.double_registration MEDIUM
"""),
    ("core/t{id}.py", """
from pathlib import Path
def f(p, lock):
    if p.exists():  #! toctou_check_then_act.race_window MEDIUM
        return 1
    p.write_text("x")  #! atomic_write_safety.missing_tmpfile_rename LOW
    if Path("/tmp/x").is_file():  #! toctou_check_then_act.race_window MEDIUM; hardcoded_path_scan MEDIUM
        return 2
    Path("/tmp/x").unlink()  #! hardcoded_path_scan MEDIUM
def g(p, q, lock):
    if p.exists():
        return 1
    q.write_text("x")  #! atomic_write_safety.missing_tmpfile_rename LOW
def h(p, lock):
    if p.exists():
        return 1
    with lock:
        p.write_text("x")  #! atomic_write_safety.missing_tmpfile_rename LOW
"""),
    ("core/x{id}.py", """
FALL = {"a": 1}
def f(cfg):
    if cfg is None:  #! context_fallback_save.fallback_without_else MEDIUM
        return FALL
    return cfg
def g(cfg):
    if cfg is None:
        return []
    if cfg is None:
        raise ValueError(cfg)
    if cfg is None:
        cfg = FALL
    return cfg
class K:
    def h(self, x):
        if x is None:  #! context_fallback_save.fallback_without_else MEDIUM
            self.x = FALL
        if x is None:  #! context_fallback_save.fail_open_none_guard MEDIUM
            y = FALL
        else:
            y = x.run()
        if x is None:
            z = None
        else:
            z = x.run()
        return y, z
"""),
    ("core/p{id}.py", """
import os
from pathlib import Path
def f(base, user_name):
    return os.path.join(base, user_name)  #! security.path_traversal_hint HIGH
def g(base, file_upload):
    return Path(base) / file_upload  #! security.path_traversal_hint HIGH
def h(base, user_name):
    p = Path(base) / user_name
    return p.resolve()
def k(base, name):
    return os.path.join(base, name)
"""),
    ("core/d{id}.py", '''
def f(a, b):  #! docstring_param_scan LOW
    """Adds.

    Args:
        a: one
        c: gone
    """
    return a + b
def g(a, *rest):
    """Adds.

    :param a: one
    :param rest: more
    """
    return a, rest
'''),
    ("core/m{id}.py", """
import threading
CACHE = {}  #! mutable_state_scan HIGH
FIXED = {"a": 1}
def f(k):
    CACHE.update(k)
    threading.Thread(target=f).start()
"""),
    ("core/v{id}.py", """
verify_ssl = False  #! config.dangerous_default HIGH
debug = False
def f(url, trust_env=True):  #! config.dangerous_default HIGH
    return url
"""),
    ("core/w{id}.py", """
import subprocess
def f():
    subprocess.run(["/usr/bin/python3", "-V"], timeout=3)  #! config.unguarded_env_access.hardcoded_path MEDIUM; hardcoded_path_scan MEDIUM
    subprocess.run(["python3", "-V"], timeout=3)
"""),
    ("core/a{id}.py", """
from typing import Any  #! type_checking.any_erosion LOW
def f(a: Any, b: Any, c: Any, d: Any, e: Any, g: Any, h: Any, i: Any, j: Any) -> int:
    return a
"""),
    ("core/u{id}.py", """
import os
def f(x):
    helper_that_is_not_there(x)  #! hallucination.undefined_call MEDIUM
    return os.fspath(x), len(x), [y for y in x], (lambda z: z)(x)
"""),
    ("core/e{id}.py", '''
PAGE_JS = """function run() { const a = [1, 2, 3]; document.title = a.join(", "); if (a) { run(; } }"""  #! embedded_syntax_scan MEDIUM; js_coverage_scan MEDIUM
GOOD_CSS = """.a { color: red; } .b { color: blue; } @media (x) { .c { color: green; } }"""
'''),
    ("core/fw{id}.py", """
from core.alpha import one, two, three  #! legacy_compat_debt.forwarding_wrapper MEDIUM; unused_shim_module LOW
from core.beta import four
__all__ = ["one", "two", "three", "four"]
"""),
    ("core/y{id}.py", """
import asyncio
async def work():
    await asyncio.sleep(1)
    return 1
async def other():
    work()  #! missing_await_scan HIGH
    await work()
async def idle(x):  #! missing_await_scan LOW
    x += 1
    return x
"""),
    ("core/o{id}.py", """
def f(path, lang):
    if path.endswith(".py"):  #! implementation_overfit.assumes_single_language MEDIUM
        return 1
    if lang == "python":
        return 2
    else:
        return 3
"""),
    ("core/z{id}.py", """
def f(x):
    return x
    y = 1  #! unreachable_scan MEDIUM
def g(xs):
    for x in xs:
        if x:
            raise ValueError(x)
            x = 2  #! unreachable_scan MEDIUM
"""),
    ("core/k{id}.py", """
def f(x=[]):  #! mutable_default_scan MEDIUM
    return x
def g(x=None, y=()):
    return x, y
"""),
    ("core/b{id}.py", """
list = 3  #! shadowed_builtin_scan LOW
class K:
    id: int = 3
    type: str
def f(id, filter):
    for max in id:  #! shadowed_builtin_scan LOW
        filter(max)
    return filter
"""),
    ("core/q{id}.py", """
DEBUG_{id} = False  #! stuck_feature_flag MEDIUM
LIVE_{id} = False
LIVE_{id} = True
def f(x):
    if DEBUG_{id}:
        return x
    if LIVE_{id}:
        return 2
    return 3
"""),
    ("core/s{id}.py", """
__all__ = ["f", "lost"]  #! export_completeness.missing_symbol HIGH
def f(x):
    return x
"""),
    ("core/i{id}.py", """
def f(x):
    import json  #! imports_in_function.stdlib LOW
    return json.dumps(x)
def g(x):
    import csv  # lazy: only here
    return csv.reader(x)
"""),
    ("core/n{id}.py", """
import os
import sys  #! unused_import_scan LOW
from typing import List as L  #! unused_import_scan LOW
def f(x):
    return os.fspath(x)
"""),
    ("core/g{id}.py", """
def _gone_{id}(x):  #! dead_code_scan LOW
    return x
def _used_{id}(x):
    return x
y = _used_{id}(1)
"""),
    ("core/env{id}.py", """
import os
def f():
    return os.environ["TOKEN_A"]  #! config.missing_env_var_check MEDIUM
def g():
    try:
        return os.environ["TOKEN_B"]
    except KeyError:
        raise
def h():
    if "TOKEN_C" in os.environ:
        return os.environ["TOKEN_C"]
    return os.environ.get("TOKEN_D")
"""),
    ("core/aw{id}.py", """
import os
def f(x):
    open("data/shared_{id}.json", "w").write(x)  #! atomic_write_safety.missing_tmpfile_rename LOW
def g():
    return open("data/shared_{id}.json").read()
def h(x):
    open("data/never_read_{id}.json", "w").write(x)
def k(x):
    open("data/shared_{id}.json", "w").write(x)
    os.replace("data/a", "data/b")
"""),
    ("core/hint{id}.py", """
def public(a: int, b) -> int:
    return a + b
def hinted(a: int) -> int:
    return a
def _private(a):
    return a
"""),
    ("tests/test_a{id}.py", """
import core.alpha
def test_one():  #! test_quality.literal_only_asserts MEDIUM
    assert 1 == 1
def test_two():  #! test_quality_scan MEDIUM
    pass
def test_three(x):  #! test_quality_scan MEDIUM
    core.alpha.run(x)
def test_four(x):
    assert core.alpha.run(x) == 3
"""),
    ("tests/test_b{id}.py", """
import os  #! test_quality.no_project_imports HIGH
def test_one(x):
    assert os.fspath(x)
"""),
    ("tests/test_c{id}.py", """
import core.alpha  #! empty_test_module MEDIUM
x = core.alpha
"""),
    ("tests/test_d{id}.py", """
import core.alpha  #! test_quality.tests_own_definitions HIGH; unused_import_scan LOW
def helper(x):
    return x + 1
def test_one():
    assert helper(1) == 2
"""),
    ("tests/test_e{id}.py", """
from core import known
def test_one():  #! simulated_instead_of_executed_test MEDIUM
    def fake(x):
        return x
    assert fake(1) == 1
def test_two():
    def fake(x):
        return x
    assert fake(1) == known.there(1)
"""),
    ("tests/test_f{id}.py", """
import pytest
from core import known
@pytest.mark.skip  #! test_suite_masking.mark_skip_unconditional MEDIUM
def test_one():
    assert known.there(1)
@pytest.mark.xfail(reason="x")  #! test_suite_masking.xfail_missing_strict MEDIUM
def test_two():
    assert known.there(2)
@pytest.mark.xfail(reason="x", strict=False)  #! test_suite_masking.xfail_non_strict MEDIUM
def test_three():
    assert known.there(3)
@pytest.mark.skipif(True, reason="x")  #! test_suite_masking.mark_skipif_literal_true MEDIUM
def test_four():
    assert known.there(4)
def test_five():
    pytest.skip("no")  #! test_suite_masking.unconditional_skip MEDIUM
    assert known.there(5)
def test_six():
    pytest.importorskip("numpy")  #! test_suite_masking.importorskip_in_test LOW
    assert known.there(6)
"""),
    ("core/bad{id}.py", """
x = 1
def f(:  #! syntax_validity.parse_error CRITICAL
    return 1
"""),
    ("core/deep{id}.py", """
def f(a):
    if a:
        for b in a:
            while b:
                with b:
                    try:  #! size.nesting_warn MEDIUM
                        b = a
                    finally:
                        a = b
"""),
    ("core/alpha{id}.py", """
def run(x):
    return x
"""),
    ("core/user{id}.py", """
from core.known import there
from core.known import not_there  #! hallucination.import_not_found MEDIUM
from core.unknown import thing
def f(a):
    return a, there, not_there, thing
y = f(1)
z = f(2)
"""),
    ("core/line{id}.py", """
password = "hunter2hunter2"  #! secrets_scan CRITICAL
# TODO later  #! todo_scan INFO
import datetime
now = datetime.datetime.now()  #! timezone_scan MEDIUM
p = "/etc/passwd"  #! hardcoded_path_scan MEDIUM
"""),
    ("core/log{id}.py", """
def f(log):
    log.info("it crashed with error")  #! log_level_scan LOW
    log.error("server ready now")  #! log_level_scan LOW
    log.debug("failed to open it, error")
"""),
    ("core/mag{id}.py", """
def f(x):
    if x > 4711:  #! magic_number_scan LOW
        return x * 3.25  #! magic_number_scan LOW
    if x > 3600:
        return x * 0.5
    return x + 256
LIMIT = 4711
"""),
    ("core/com{id}.py", """
def f(x):
    return x
y = 1
z = 3
# x = 1  #! commented_code_scan LOW
# if x:
#     foo(x)
"""),
    ("core/resp{id}.py", """
def f(u, requests):
    r = requests.get(u, timeout=3)  #! response_status_scan MEDIUM
    return r
"""),
    ("core/ctx{id}.py", """
def f(x, logger):
    try:
        return int(x)
    except Exception as e:
        logger.error("bad thing")  #! log_context_scan LOW
        logger.error("bad %s", e)
        raise
"""),
    ("core/res{id}.py", """
def f(p):
    h = open(p)  #! resource_leak_scan MEDIUM
    with open(p) as g:
        return h, g
"""),
    ("core/mig{id}.py", """
# DEPRECATED, to go  #! stale_migration_marker LOW
x = 1
"""),
    ("core/x{id}_js.py", r'''
A = "a\nb"  #! embedded_string.unescaped_newline MEDIUM
B = "a\\nb"
'''),
    ("core/na{id}.py", """
def a_b(): return 1
def c_d(): return 2
def e_f(): return 3
def g_h(): return 4
def i_j(): return 5
def kL(): return 6  #! naming_scan LOW
"""),
    ("core/ad{id}.py", """
def f(d):
    d["new_key_{id}"] = d.pop("old_key_{id}")  #! legacy_compat_debt.shape_adapter_without_producer MEDIUM
    return d
"""),
    ("core/empty{id}.py", "  #! empty_output.zero_bytes HIGH"),
    ("web/a{id}.js", """
import {x} from './b{id}.js'
function go() {  #! syntax_validity.parse_error CRITICAL
  if (x) {
    run("(")
  }
"""),
    ("web/s{id}.js", """
const a = '}'; // }
function go() {
  run(a))  #! syntax_validity.parse_error CRITICAL
}
"""),
    ("ios/a{id}.swift", """
import UIKit
let a = b!.c  #! swift.force_unwrap HIGH
var d: String!  #! swift.implicitly_unwrapped_optional LOW
"""),
    ("core/sup{id}.py", """
password = "hunter2hunter2"  # noqa: secrets_scan
"""),
    ("core/zones{id}.py", "def write_a():\n    return 1\ndef read_b():\n    return 2\ndef parse_c():\n    return 3\n"),
    ("core/w{id}_v2.py", "x = 1\n"),
    ("ring/r{id}.py", "from ring import r{next}\ndef go(x):\n    return r{next}.go(x)\n"),
    ("core/sa{id}.py", "def keep(x):\n    open('data/common.json', 'w').write(x)  #! atomic_write_safety.missing_tmpfile_rename MEDIUM\n"),
    ("tools/sb{id}.py", "def keep(x):\n    return open('data/common.json').read() + x\ndef put(x):\n    open('data/common.json', 'w').write(x)  #! atomic_write_safety.missing_tmpfile_rename MEDIUM\n"),
    ("core/ca{id}.py", "from dataclasses import dataclass\n@dataclass\nclass Order:\n    a: int\n    b: str\n"),
    ("tools/cb{id}.py", "from dataclasses import dataclass\n@dataclass\nclass Order:\n    a: str\n    c: int\n"),
    ("tools/main{id}.py", "import os\ndef main():\n    return os.environ.get('API_KEY_{id}')\nif __name__ == '__main__':\n    main()\n"),
    ("tools/long{id}.py", "x = 1\n" * 1300),
]
#: Files that stand in every tree, once.
FIXED = [("core/known.py", "def there():\n    return 1\n"), ("core/__init__.py", "")]


def _parse(text: str) -> tuple[str, list[tuple[str, str, int]]]:
    """The file's text, and (check, severity, line) of its marks."""
    out, marks = [], []
    for n, line in enumerate(text.removeprefix("\n").split("\n"), 1):
        code, _, said = line.partition("  #! ")
        out.append(code)
        for m in said.split("; ") if said else []:
            check, severity = m.split()
            marks.append((check, severity, n))
    return "\n".join(out), marks


_PARSED = [(path, *_parse(text)) for path, text in PLANTS]
CHECKS = sorted({c for _, _, marks in _PARSED for c, _, _ in marks})


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a file for each document."""
    pick = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in _PARSED]), (F.col("doc_id") % len(_PARSED) + 1).cast("int"))
    # {next}: the partner of a document among those of its plant, two by two.
    n = len(_PARSED)
    partner = F.when(F.floor(F.col("doc_id") / n) % 2 == 0, F.col("doc_id") + n).otherwise(F.col("doc_id") - n)
    name = lambda c: F.replace(F.replace(c, F.lit("{id}"), F.col("doc_id").cast("string")), F.lit("{next}"), partner.cast("string"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return docs.select(name(pick(0)).alias("path"), name(pick(1)).alias("text")).union(spark.createDataFrame(FIXED, "path string, text string"))


_MADE: dict[tuple[str, str], audit.Context] = {}
_FOUND: dict[tuple[str, str], DataFrame] = {}


def context(spark: SparkSession, sf_dir: str) -> audit.Context:
    """The tree's files, lines and facts, written once for an application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _MADE:
        _MADE[key] = audit.context(spark, tree(spark, sf_dir))
    return _MADE[key]


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of all gates over the tree, written once for an application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _FOUND:
        c = context(spark, sf_dir)
        got = audit.run_gates(c, [g for g, state in audit.resolve_gates() if state == "run"])
        _FOUND[key] = materialize(spark, report.suppressed(got, c.lines), "tree-findings")
    return _FOUND[key]


def _expected(check: str) -> str:
    """SQL for the findings of a check: its marks, joined with the documents."""
    rows = [(k, path, line, severity) for k, (path, _, marks) in enumerate(_PARSED) for c, severity, line in marks if c == check]
    values = ", ".join(f"({k}, '{path}', {line}, '{severity}')" for k, path, line, severity in rows)
    return f"SELECT '{check}' AS check_id, replace(p.path, '{{id}}', doc_id::VARCHAR) AS path, p.line_no::INT AS line_no, p.severity AS severity FROM documents JOIN (VALUES {values}) p(k, path, line_no, severity) ON doc_id % {len(_PARSED)} = p.k"


def _check(check: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return found(spark, sf_dir).where(F.col("check_id") == check).select("check_id", "path", F.col("line_no").cast("int").alias("line_no"), "severity")

    run.__name__ = "check_" + check.replace(".", "_")
    run.__doc__ = f"Findings of {check} over the tree."
    return run


def number(path: str) -> int:
    """The plant that a path stands for."""
    return next(k for k, (p, _, _) in enumerate(_PARSED) if p == path)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The tree in SQL: files(doc_id, k, path, text) and src(path, line_no, line).
SQL_TREE = (
    f"WITH p(k, path, text) AS (VALUES {', '.join(f'({k}, {_q(path)}, {_q(text)})' for k, (path, text, _) in enumerate(_PARSED))}), "
    f"d AS (SELECT doc_id, doc_id % {len(_PARSED)} AS k, CASE WHEN doc_id // {len(_PARSED)} % 2 = 0 THEN doc_id + {len(_PARSED)} ELSE doc_id - {len(_PARSED)} END AS partner FROM documents), "
    "files AS (SELECT doc_id, k, replace(p.path, '{id}', doc_id::VARCHAR) AS path, replace(replace(p.text, '{id}', doc_id::VARCHAR), '{next}', partner::VARCHAR) AS text FROM d JOIN p USING (k) "
    f"UNION ALL SELECT -1, -1, path, text FROM (VALUES {', '.join(f'({_q(a)}, {_q(b)})' for a, b in FIXED)}) f(path, text)), "
    "src AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM files), "
    f"py AS (SELECT * FROM src WHERE path LIKE '%.py' AND path NOT LIKE 'core/bad%' AND path NOT LIKE 'core/d%' AND path NOT LIKE 'core/e%') "
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"check_" + c.replace(".", "_"): _check(c) for c in CHECKS}


def oracles() -> dict[str, str]:
    return {"check_" + c.replace(".", "_"): _expected(c) for c in CHECKS}
