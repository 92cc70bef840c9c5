"""Checks over facts: each a filter, an aggregate or a join of fact rows, giving (check_id, path, line_no, detail, severity, impact)."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths

FOUND = ["check_id", "path", "line_no", "detail", "severity", "impact"]
# Fixed values of the checks.
BROAD = ["Exception", "BaseException"]
CONTROL_FLOW = ["KeyboardInterrupt", "BrokenPipeError", "GeneratorExit", "SystemExit", "StopIteration", "StopAsyncIteration", "CancelledError"]
# Calls that need timeout=.
NEEDS_TIMEOUT = [
    "subprocess.run", "subprocess.Popen", "subprocess.call", "subprocess.check_call", "subprocess.check_output",
    "requests.get", "requests.post", "requests.put", "requests.delete", "requests.patch", "requests.head", "requests.options", "requests.request",
    "urllib.request.urlopen", "http.client.HTTPConnection", "http.client.HTTPSConnection", "sqlite3.connect", "socket.create_connection", "paramiko.SSHClient.connect", "paramiko.SSHClient.exec_command",
]
SUBPROCESS = ["subprocess.run", "subprocess.Popen", "subprocess.call", "subprocess.check_call", "subprocess.check_output"]
RNG = "^(?:(?:np|numpy)\\.random\\.\\w+|random\\.(?:random|randint|randrange|choice|choices|shuffle|sample|uniform|gauss|normalvariate|betavariate|expovariate|triangular)|torch\\.rand\\w*|tf\\.random\\.\\w+)$"
SEEDS = "(^|\\.)(seed|manual_seed|set_seed|default_rng|set_random_seed)$"
# Registrations, by the end of the call's dotted name.
REGISTER = ["atexit.register", "signal.signal", "scheduler.add", "scheduler.add_job", "schedule.every", "EventEmitter.on", "subscribe", "add_listener"]
BUILTINS = (
    "list dict set tuple str int float bool type id input print len range map filter open hash any all min max sum sorted next iter super format zip enumerate abs"
    " round bytes object dir vars chr ord hex oct bin pow repr callable isinstance issubclass getattr setattr hasattr property classmethod staticmethod frozenset"
    " compile eval exec globals locals breakpoint complex bytearray memoryview slice reversed"
).split()
DANGEROUS = ["eval", "exec", "os.system", "pickle.loads", "pickle.load", "marshal.loads", "yaml.load"]
#: Methods of numpy's and Python's generators that draw numbers.
EXPENSIVE = r"^(re\.compile|subprocess\.|requests\.|open$)"
STDLIB = sorted(sys.stdlib_module_names)
REASON = r"(?i)#.*(circular|lazy|optional|avoid|heavy|noqa|cycle|defer|startup|import cost)"


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def yes(name: str) -> Column:
    return F.coalesce(attr(name) == "True", F.lit(False))


def _of(facts: DataFrame, fact: str) -> DataFrame:
    return facts.where(F.col("fact") == fact)


def _found(rows: DataFrame, check: str | Column, detail: Column, severity: str, impact: str = "REVISE") -> DataFrame:
    check = F.lit(check) if isinstance(check, str) else check
    return rows.select(check.alias("check_id"), "path", F.col("line").alias("line_no"), detail.alias("detail"), F.lit(severity).alias("severity"), F.lit(impact).alias("impact"))


def handlers(facts: DataFrame) -> DataFrame:
    """broad_except.* and exception_swallow_scan."""
    h = _of(facts, "handler").withColumn("types", F.split("name", ",")).withColumn("broad", yes("bare") | F.arrays_overlap(F.split("name", ","), F.array(*map(F.lit, BROAD))))
    widest = yes("bare") | F.array_contains("types", "BaseException")
    sentinel = F.when(yes("reraises"), None).when(widest, "bare_or_base").when(F.col("broad") & yes("silent_return"), "silent_return").when(F.col("broad") & yes("log_swallow"), "log_swallow")
    narrow = ~F.col("broad") & (F.size("items") == 1) & (F.col("items")[0] == "Pass") & ~F.arrays_overlap("types", F.array(*map(F.lit, CONTROL_FLOW)))
    parts = [
        _found(h.where(yes("bare") & ~yes("reraises")), "broad_except.bare", F.lit("bare except"), "HIGH"),
        _found(h.where(F.array_contains("types", "BaseException") & ~yes("reraises")), "broad_except.base_exception", F.col("name"), "HIGH"),
        _found(h.where(F.col("broad") & yes("only_pass")), "broad_except.swallow", F.col("name"), "HIGH"),
        _found(h.where(F.col("broad") & yes("silent_return")), "broad_except.return_none", F.col("name"), "MEDIUM"),
        _found(h.where(F.col("broad") & yes("log_swallow")), "broad_except.log_swallow", F.col("name"), "MEDIUM"),
        _found(h.withColumn("kind", sentinel).where("kind IS NOT NULL"), F.concat(F.lit("broad_except.hidden_sentinel."), "kind"), F.col("name"), "MEDIUM"),
        _found(h.where((F.col("broad") & yes("only_pass")) & ~paths.is_test(F.col("path"))), "exception_swallow_scan", F.col("name"), "HIGH"),
        _found(h.where(narrow & ~paths.is_test(F.col("path"))), "exception_swallow_scan", F.col("name"), "MEDIUM"),
        _found(h.where(F.col("broad") & yes("only_logs") & ~yes("reraises")), "broad_catch_scan", F.col("name"), "MEDIUM"),
    ]
    return reduce(DataFrame.unionByName, parts)


def expensive_loops(facts: DataFrame, roots: list[str]) -> DataFrame:
    """performance.expensive_in_loop: expensive calls in loops of files under sensitive roots; none are sensitive unless named."""
    c = _of(facts, "call").where((attr("loops").cast("int") > 0) & F.col("name").rlike(EXPENSIVE))
    here = reduce(lambda a, b: a | b, [F.col("path").startswith(r) for r in roots], F.lit(False))
    return _found(c.where(here), "performance.expensive_in_loop", F.col("name"), "MEDIUM")


def local_hits(facts: DataFrame) -> DataFrame:
    """What the rules over one function or file found."""
    h = _of(facts, "hit")
    return h.select(F.col("name").alias("check_id"), "path", F.col("line").alias("line_no"), attr("detail").alias("detail"), attr("severity").alias("severity"), attr("impact").alias("impact"))


def too_deep(facts: DataFrame) -> DataFrame:
    """Meta findings of files that could not be read as a tree: one file's failure is one row."""
    return _found(_of(facts, "too_deep"), "meta.too_deep", F.col("name"), "HIGH")


def calls(facts: DataFrame) -> DataFrame:
    """Security, reliability, encoding, ML and print checks of calls."""
    c = _of(facts, "call").where(F.col("path").rlike(r"\.pyi?$")).withColumn("last", F.element_at(F.split("name", r"\."), -1))
    parts = [
        _found(c.where(F.col("last").isin("execute", "executemany", "query", "raw") & yes("sql")), "security_scan", F.concat(F.lit("dynamic SQL in "), "name"), "CRITICAL", "BLOCK"),
        _found(c.where(F.col("name").isin(*DANGEROUS) & ~((F.col("name") == "yaml.load") & F.array_contains("items", "Loader"))), "security_scan", F.concat(F.lit("dangerous call "), "name"), "HIGH"),
        _found(c.where(F.col("name").isin(*SUBPROCESS) & attr("true").contains("shell")), "security_scan", F.lit("shell=True"), "HIGH"),
        _found(c.where(F.col("name").isin(*SUBPROCESS) & attr("true").contains("shell") & (attr("built") == "True")), "security.command_injection", F.col("name"), "CRITICAL", "BLOCK"),
        _found(c.where(F.col("name").isin(*SUBPROCESS) & attr("true").rlike("text|universal_newlines") & ~F.array_contains("items", "encoding")), "encoding.subprocess_missing_encoding", F.col("name"), "MEDIUM"),
        _found(c.where(F.col("name").isin(*NEEDS_TIMEOUT) & ~F.array_contains("items", "timeout")), "reliability.blocking_call_missing_timeout", F.col("name"), "MEDIUM"),
        _found(c.where((F.col("last") == "shift") & (attr("negative") == "True")), "ml.lookahead_negative_shift", attr("first"), "HIGH"),
        _found(c.where((F.col("last") == "train_test_split") & ~F.array_contains("items", "random_state")), "ml.nondeterministic_split", F.col("name"), "MEDIUM"),
        _found(c.where(F.col("last").isin("fit", "fit_transform") & yes("held_out")), "ml.scaler_fit_on_test", attr("first"), "HIGH"),
        _found(c.where((F.col("name") == "print") & (F.col("scope") != "main") & ~paths.is_test(F.col("path")) & ~F.lower("path").rlike("cli|__main__")), "debug_print_scan", F.col("scope"), "LOW", "WARN"),
    ]
    seeded = c.where(F.col("name").rlike(SEEDS) | F.array_contains("items", "random_state") | F.array_contains("items", "seed")).select("path").distinct()
    rng = c.where(F.col("name").rlike(RNG) & ~F.col("name").rlike(SEEDS)).groupBy("path").agg(F.min("line").alias("line"), F.min("name").alias("name")).join(seeded, "path", "left_anti")
    kind = F.array_compact(F.array(*[F.when((F.col("name") == r) | F.col("name").endswith("." + r), F.lit(r)) for r in REGISTER]))
    twice = c.withColumn("kind", F.get(kind, F.lit(0))).where("kind IS NOT NULL").groupBy("path", F.col("kind").alias("name")).agg(F.max("line").alias("line"), F.count("*").alias("n")).where("n >= 2")
    asyncs = _of(facts, "function").where(yes("is_async")).select("path", "name").distinct()
    syncs = _of(facts, "function").where(~yes("is_async")).select("path", "name").distinct()
    alone = asyncs.join(syncs, ["path", "name"], "left_anti")
    runners = ["run", "run_until_complete", "run_coroutine_threadsafe", "create_task", "gather", "ensure_future"]
    handed = c.where(F.col("last").isin(*runners)).select("path", F.col("line").alias("at")).distinct()
    lost = c.where((attr("awaited") != "True") & (attr("in_async") == "True")).join(alone, ["path", "name"], "left_semi").alias("c").join(handed.alias("h"), (F.col("c.path") == F.col("h.path")) & (F.col("c.line") == F.col("h.at")), "left_anti")
    parts += [
        _found(rng, "ml.missing_random_seed", F.col("name"), "MEDIUM"),
        _found(twice, "runtime_duplicate_side_effect.double_registration", F.col("name"), "MEDIUM"),
        _found(lost, "missing_await_scan", F.col("name"), "HIGH"),
    ]
    return reduce(DataFrame.unionByName, parts)


def functions(facts: DataFrame, limits: dict | None = None) -> DataFrame:
    """Size, hints, defaults, tests and reachability. limits: the profile's thresholds."""
    lim = {"function_warn": 100, "function_revise": 150, "nesting_warn": 5, "nesting_revise": 8, **(limits or {})}
    f = _of(facts, "function")
    tests = f.where(F.col("name").startswith("test") & paths.is_test(F.col("path")))
    n = attr("n_asserts").cast("int")
    public = f.where(~F.col("name").startswith("_") & ~yes("nested") & ~paths.is_test(F.col("path")))
    from quarry.operators import size

    big = size.function_sizes(f.select("path", "name", F.col("line").alias("start_line"), "end_line"), lim["function_warn"], lim["function_revise"])
    deep = size.nesting(_of(facts, "depth").select("path", attr("line").cast("int").alias("line"), F.col("name").cast("int").alias("depth")), lim["nesting_warn"], lim["nesting_revise"])
    modules = facts.select("path").distinct().where(paths.is_test(F.col("path")) & paths.basename(F.col("path")).startswith("test_"))
    parts = [
        _found(_of(facts, "mutable_default"), "mutable_default_scan", F.col("name"), "MEDIUM"),
        _found(_of(facts, "unreachable"), "unreachable_scan", F.concat(F.lit("after "), "name"), "MEDIUM"),
        _found(public.where(~yes("hinted")), "type_checking.missing_hints_public_api", F.col("name"), "LOW", "WARN"),
        _found(tests.where(yes("empty")), "test_quality_scan", F.concat(F.lit("empty "), "name"), "MEDIUM"),
        _found(tests.where(~yes("empty") & (n == 0)), "test_quality_scan", F.concat(F.lit("no assert "), "name"), "MEDIUM"),
        _found(tests.where(yes("literal_asserts")), "test_quality.literal_only_asserts", F.col("name"), "MEDIUM"),
        _found(modules.join(tests.select("path"), "path", "left_anti").withColumn("line", F.lit(1)), "empty_test_module", F.lit("no test function"), "MEDIUM"),
        _found(big.withColumn("line", F.col("start_line")), F.concat(F.lit("size."), "size_class"), F.col("name"), "MEDIUM"),
        _found(deep, F.concat(F.lit("size."), "size_class"), F.col("depth").cast("string"), "MEDIUM"),
        _found(_of(facts, "syntax_error").where(F.col("path").rlike(r"\.pyi?$")), "syntax_validity.parse_error", F.col("name"), "CRITICAL", "BLOCK"),
        _found(_of(facts, "bound").where(F.col("name").isin(*BUILTINS)), "shadowed_builtin_scan", F.col("name"), "LOW", "WARN"),
    ]
    masks = _of(facts, "decorator")
    kinds = [("mark_skip_unconditional", masks.where(F.col("name").endswith("mark.skip"))), ("xfail_missing_strict", masks.where(F.col("name").endswith("mark.xfail") & ~attr("attrs_text").contains("strict"))), ("xfail_non_strict", masks.where(F.col("name").endswith("mark.xfail") & attr("attrs_text").contains("strict=False"))), ("mark_skipif_literal_true", masks.where(F.col("name").endswith("mark.skipif") & attr("attrs_text").contains("skipif(True")))]
    parts += [_found(rows, f"test_suite_masking.{kind}", attr("of"), "MEDIUM") for kind, rows in kinds]
    c = _of(facts, "call").where(paths.is_test(F.col("path")))
    parts += [_found(c.where(F.col("name") == "pytest.skip"), "test_suite_masking.unconditional_skip", F.col("scope"), "MEDIUM"), _found(c.where((F.col("name") == "pytest.importorskip") & (attr("in_function") == "True")), "test_suite_masking.importorskip_in_test", F.col("scope"), "LOW", "WARN")]
    return reduce(DataFrame.unionByName, parts)


def names(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """Unused imports, dead code, missing exports, stuck flags, dangerous defaults, unguarded env reads, imports in functions."""
    word = lines.select("path", "line_no", F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("w"))
    counts = word.groupBy("w").agg(F.count("*").alias("n"))
    imports = _of(facts, "import").where((attr("bound") != "") & (attr("kind") != "dynamic"))
    at = imports.select("path", F.explode(F.sequence("line", "end_line")).alias("line_no")).distinct()
    used = word.join(at, ["path", "line_no"], "left_anti").select("path", F.col("w").alias("bound")).distinct()
    exported = _of(facts, "exported").select("path", F.col("name").alias("bound"))
    loose = imports.withColumn("bound", attr("bound")).where(~F.col("bound").startswith("_") & (F.col("bound") != "annotations") & (attr("asname") != F.element_at(F.split("name", r"\."), -1)) & (paths.basename(F.col("path")) != "__init__.py"))
    unused = loose.join(used, ["path", "bound"], "left_anti").join(exported, ["path", "bound"], "left_anti")
    private = _of(facts, "symbol").where((F.col("scope") == "") & (attr("kind") == "function") & F.col("name").startswith("_") & ~F.col("name").startswith("__"))
    dead = private.join(counts.where("n > 1").select(F.col("w").alias("name")), "name", "left_anti").join(exported.select(F.col("bound").alias("name"), "path"), ["name", "path"], "left_anti")
    defined = _of(facts, "symbol").select("path", "name").union(_of(facts, "assign").select("path", "name")).union(imports.select("path", attr("bound"))).distinct()
    missing = _of(facts, "exported").join(defined, ["path", "name"], "left_anti").join(_of(facts, "star").select("path").distinct(), "path", "left_anti")
    assign = _of(facts, "assign")
    once = assign.groupBy("path", "name").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    stuck = assign.where((attr("at_module") == "True") & (attr("value") == "False") & F.col("name").rlike("^[A-Z][A-Z0-9_]*$")).join(once, ["path", "name"]).join(_of(facts, "tested").select("path", "name").distinct(), ["path", "name"], "left_semi")
    guards = _of(facts, "handler").where(yes("bare") | F.col("name").contains("KeyError")).select("path", "scope").distinct()
    asked = _of(facts, "env_asked").select("path", "scope", "name").distinct()
    env = _of(facts, "env").where(attr("guarded") == "False").join(guards, ["path", "scope"], "left_anti").join(asked, ["path", "scope", "name"], "left_anti")
    # A reason beside the import, or on the line above, excuses it.
    reason = lines.where(F.col("line").rlike(REASON)).select("path", F.explode(F.array("line_no", F.col("line_no") + 1)).alias("line")).distinct()
    top = F.element_at(F.split("name", r"\."), 1)
    inner = _of(facts, "import").where((attr("in_function") == "True") & attr("kind").isin("import", "from") & top.isin(*STDLIB)).join(reason, ["path", "line"], "left_anti")
    return reduce(
        DataFrame.unionByName,
        [
            _found(unused, "unused_import_scan", F.col("bound"), "LOW", "WARN"),
            _found(dead, "dead_code_scan", F.col("name"), "LOW", "WARN"),
            _found(missing, "export_completeness.missing_symbol", F.col("name"), "HIGH", "BLOCK"),
            _found(stuck, "stuck_feature_flag", F.col("name"), "MEDIUM"),
            _found(env, "config.missing_env_var_check", F.col("name"), "MEDIUM"),
            _found(inner, "imports_in_function.stdlib", F.col("name"), "LOW", "WARN"),
        ],
    )


# Names that say what a write is for.
STATE_LIKE, PERSISTS, INIT_LIKE = "(?i)state|status|cache|config|manifest|registry|index|session|lock|db|store", "(?i)save|persist|commit|store|checkpoint|flush|dump", "(?i)init|setup|bootstrap|install|migrate|scaffold"
UNIQUE = "(?i)uuid|tempfile|mkstemp|mkdtemp|NamedTemporary|tmp_path|time_ns|getpid|timestamp"


def writes(facts: DataFrame) -> DataFrame:
    """atomic_write_safety: writes without a replace in the same function. A literal target that no file reads gives none,
    one that only its own file reads LOW, one that others read MEDIUM; another target by the names it goes by, none if it is
    unique to the call; MEDIUM in functions that set up falls to LOW."""
    w = _of(facts, "write")
    safe = w.where(attr("kind").isin("os.replace", "os.rename")).select("path", "scope").distinct()
    bare = w.where(~attr("kind").isin("os.replace", "os.rename", "json.dump")).join(safe, ["path", "scope"], "left_anti")
    read = _of(facts, "read").where("name <> ''").select(F.col("name"), F.col("path").alias("reader")).distinct()
    per = read.groupBy("name").agg(F.count("*").alias("readers"))
    j = bare.join(per, "name", "left").join(read.withColumn("own", F.lit(1)).withColumnRenamed("reader", "path"), ["name", "path"], "left")
    hint, function = attr("hint"), F.element_at(F.split("scope", r"\."), -1)
    literal = F.when(F.col("readers").isNull(), None).when(F.col("readers") - F.coalesce("own", F.lit(0)) > 0, "MEDIUM").otherwise("LOW")
    other = F.when(hint.rlike(UNIQUE), None).when(hint.rlike(STATE_LIKE) | function.rlike(PERSISTS), "MEDIUM").otherwise("LOW")
    graded = j.withColumn("sev", F.when(F.col("name") != "", literal).otherwise(other)).where("sev IS NOT NULL").withColumn("sev", F.when((F.col("sev") == "MEDIUM") & function.rlike(INIT_LIKE), "LOW").otherwise(F.col("sev")))
    made = graded.select(F.lit("atomic_write_safety.missing_tmpfile_rename").alias("check_id"), "path", F.col("line").alias("line_no"), F.coalesce(F.nullif("name", F.lit("")), hint).alias("detail"), F.col("sev").alias("severity"))
    return made.withColumn("impact", F.when(F.col("severity") == "MEDIUM", "REVISE").otherwise("WARN"))


def imported_names(facts: DataFrame, files: DataFrame) -> DataFrame:
    """hallucination.import_not_found: a name taken from a module of the tree that the module neither defines nor imports
    and that is no module below it."""
    whole = paths.module_names(files.select("path"))
    member = _of(facts, "import").where((attr("kind") == "member") & ~F.col("name").startswith(".")).select("path", "line", "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("module"), F.element_at(F.split("name", r"\."), -1).alias("taken"))
    known = member.join(whole.select("module", F.col("path").alias("of")), "module")
    has = (
        _of(facts, "bound").where("scope = ''").select(F.col("path").alias("of"), F.col("name").alias("taken"))
        .union(_of(facts, "symbol").where("scope = ''").select(F.col("path").alias("of"), F.col("name").alias("taken")))
        .union(_of(facts, "import").select(F.col("path").alias("of"), attr("bound").alias("taken")))
        .distinct()
    )
    open_ = _of(facts, "star").select(F.col("path").alias("of")).union(facts.where("fact IN ('syntax_error', 'too_deep')").select(F.col("path").alias("of"))).distinct()
    lost = known.join(has, ["of", "taken"], "left_anti").join(open_, "of", "left_anti").join(whole.select(F.col("module").alias("name")), "name", "left_anti")
    return _found(lost, "hallucination.import_not_found", F.col("name"), "MEDIUM")


def project_tests(facts: DataFrame, files: DataFrame) -> DataFrame:
    """test_quality.no_project_imports: test files with tests that import nothing of the tree's packages; and
    simulated_instead_of_executed_test: tests that import from them but call only their own functions."""
    roots = files.select(paths.package_root(F.col("path")).alias("root")).where("root IS NOT NULL").distinct()
    used = _of(facts, "import").select("path", "scope", attr("bound").alias("bound"), F.element_at(F.split("name", r"\."), 1).alias("root")).join(roots, "root")
    tests = _of(facts, "function").where(F.col("name").startswith("test_") & paths.is_test(F.col("path"))).select("path").distinct()
    some = roots.limit(1).select(F.lit(True).alias("some"))
    alone = tests.join(used.select("path").distinct(), "path", "left_anti").join(F.broadcast(some)).withColumn("line", F.lit(1))
    own = _of(facts, "simulated")
    called = own.select("path", "line", "name", F.explode("items").alias("bound"))
    real = called.join(used.where("bound <> ''").select("path", "bound").distinct(), ["path", "bound"]).select("path", "line").distinct()
    only = own.join(used.select("path").distinct(), "path", "left_semi").join(real, ["path", "line"], "left_anti")
    return _found(alone, "test_quality.no_project_imports", F.lit("no import of the project"), "HIGH").unionByName(_found(only, "simulated_instead_of_executed_test", F.concat_ws(": ", "name", attr("own")), "MEDIUM"))


def same_functions(facts: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """duplication.normalized_function: functions whose normal form another file's function has; with `touched` (path), those
    of touched files equal to one of an untouched file, and cross_touched_duplicate between touched ones. One row for each
    function, naming the first other file, so equal copies cost no pairs."""
    n = _of(facts, "normal").where(~paths.is_test(F.col("path"))).select("path", "line", "name", attr("hash").alias("hash"))
    if touched is None:
        n = n.withColumn("t", F.lit(False))
    else:
        n = n.join(touched.select("path").distinct().withColumn("t", F.lit(True)), "path", "left").fillna({"t": False})
    # The two least files of each hash and side: one of them is another file than the row's.
    per = n.select("hash", "t", "path").distinct().groupBy("hash", "t").agg(F.min("path").alias("a"), F.max("path").alias("b"), F.count("*").alias("k"))
    other = lambda side: per.where(F.col("t") == side).select("hash", "a", "b", "k")
    named = F.when(F.col("a") != F.col("path"), F.col("a")).otherwise(F.col("b"))
    if touched is None:
        hit = n.join(other(False), "hash").where("k >= 2").withColumn("other", named)
        return _found(hit, "duplication.normalized_function", F.concat_ws(" = ", "name", "other"), "MEDIUM")
    old = n.where("t").join(other(False), "hash").withColumn("other", named)
    both = n.where("t").join(other(True), "hash").where("k >= 2").withColumn("other", named)
    return _found(old, "duplication.normalized_function", F.concat_ws(" = ", "name", "other"), "HIGH").unionByName(_found(both, "duplication.cross_touched_duplicate", F.concat_ws(" = ", "name", "other"), "MEDIUM"))


def new_writers(now: DataFrame, before: DataFrame) -> DataFrame:
    """illegal_authority_writer: files that had no function named like a writer and now have one."""
    writer = F.col("name").rlike("^(write|save|commit|delete|persist)_")
    old = before.select("path").distinct().join(_of(before, "function").where(writer).select("path").distinct(), "path", "left_anti")
    new = _of(now, "function").where(writer).groupBy("path").agg(F.min("line").alias("line"), F.min_by("name", "line").alias("name"))
    return _found(new.join(old, "path"), "illegal_authority_writer.new_writer_in_readonly_module", F.col("name"), "MEDIUM")


def import_order(now: DataFrame, before: DataFrame) -> DataFrame:
    """init_order_regression: imports of an __init__.py that went, or that changed their order."""

    def ordered(f: DataFrame, name: str) -> DataFrame:
        i = _of(f, "import").where(paths.basename(F.col("path")) == "__init__.py").where(attr("kind").isin("import", "from")).groupBy("path", "name").agg(F.min("line").alias("line"))
        return i.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda x: x["name"]).alias(name))

    j = ordered(before, "old").join(ordered(now, "new"), "path", "left").withColumn("new", F.coalesce("new", F.array().cast("array<string>")))
    gone = F.size(F.array_except("old", "new"))
    moved = F.filter("old", lambda x: F.array_contains("new", x)) != F.filter("new", lambda x: F.array_contains("old", x))
    bad = j.where((gone > 0) | moved).withColumn("line", F.lit(1))
    return _found(bad, "init_order_regression.import_order_changed", F.concat_ws(" ", gone.cast("string"), F.lit("gone"), F.when(moved, "order changed")), "MEDIUM")


def against_previous(now: DataFrame, before: DataFrame) -> DataFrame:
    """Facts of two versions: contract_shape_drift.* and api.public_function_signature_change."""

    def fields(f: DataFrame, n: str) -> DataFrame:
        return _of(f, "contract").select("path", "name", "line", F.split(attr("required"), ",").alias("req"), F.explode_outer("items").alias("field")).select("path", "name", F.col("line").alias(f"line_{n}"), F.regexp_extract("field", "^[^:]+", 0).alias("field"), F.array_contains("req", F.regexp_extract("field", "^[^:]+", 0)).alias(f"req_{n}"))

    shared = _of(now, "contract").select("path", "name", "line").join(_of(before, "contract").select("path", "name"), ["path", "name"])
    j = fields(now, "new").join(fields(before, "old"), ["path", "name", "field"], "full_outer").join(shared, ["path", "name"]).where("field IS NOT NULL")
    kind = F.when(F.col("line_new").isNull(), "field_removed").when(F.col("line_old").isNull() & F.col("req_new"), "required_field_added").when(F.col("line_old").isNull(), "field_added")
    drift = _found(j.withColumn("kind", kind).where("kind IS NOT NULL"), F.concat(F.lit("contract_shape_drift."), "kind"), F.concat_ws(".", "name", "field"), "HIGH")

    def signature(f: DataFrame, n: str) -> DataFrame:
        return _of(f, "function").where(~F.col("name").startswith("_") & ~yes("nested")).select("path", "scope", "name", F.col("items").alias(n), *(["line"] if n == "new" else []))

    gone = signature(now, "new").join(signature(before, "old"), ["path", "scope", "name"]).withColumn("lost", F.array_except("old", "new")).where(F.size("lost") > 0)
    return drift.unionByName(_found(gone, "api.public_function_signature_change", F.concat(F.col("name"), F.lit(": "), F.array_join("lost", ",")), "HIGH"))


def groups(facts: DataFrame, lines: DataFrame, files: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """The checks over one version of a tree, in groups."""
    return {
        "handlers": lambda: handlers(facts), "calls": lambda: calls(facts), "functions": lambda: functions(facts), "names": lambda: names(facts, lines), "writes": lambda: writes(facts), "local": lambda: local_hits(facts),
        "too_deep": lambda: too_deep(facts), "imported_names": lambda: imported_names(facts, files), "project_tests": lambda: project_tests(facts, files), "same_functions": lambda: same_functions(facts),
    }
