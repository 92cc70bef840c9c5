"""The audit: discover, guard, check, report. And the eight maps."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.operators import blocks, corpus_checks, fact_checks, graph, line_checks, report, size, structure, text_checks
from quarry.plans import maps
from quarry.session import materialize
from quarry.sources import other_languages, python_facts, tables

# The profile's thresholds, and those of a profile that names none.
DEFAULTS = {"file_warn": 750, "file_revise": 1000, "function_warn": 100, "function_revise": 150, "nesting_warn": 5, "nesting_revise": 8}
BARE = {"file_warn": 600, "file_revise": 800, "function_warn": 80, "function_revise": 120, "nesting_warn": 4, "nesting_revise": 6}
FOUND = "check_id string, path string, line_no int, detail string, severity string, impact string"


@dataclass
class Context:
    """The tables that gates read; each is written once and read by all."""

    spark: SparkSession
    files: DataFrame
    lines: DataFrame
    facts: DataFrame
    profile: dict = field(default_factory=lambda: dict(DEFAULTS))
    raw: DataFrame | None = None
    touched: DataFrame | None = None
    before: DataFrame | None = None


def profile(text: str | None) -> tuple[dict, list[str]]:
    """A profile (JSON) over the defaults, and what is wrong with it. Without one, the defaults."""
    if text is None:
        return dict(DEFAULTS), []
    try:
        got = json.loads(text)
        if not isinstance(got, dict):
            raise ValueError("not an object")
    except ValueError as e:
        return dict(DEFAULTS), [f"profile: {e}"]
    return {**BARE, **got}, []


def find_profile(spark: SparkSession, folders: list[str], name: str = "profile.json") -> str | None:
    """The text of the first profile in folders, which come from the project up to its ancestors."""
    for f in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{f.rstrip('/')}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.read.text(str(path), wholetext=True).first()[0]
    return None


def _sizes(c: Context) -> DataFrame:
    p = c.profile
    sized = size.file_sizes(c.lines, p["file_warn"], p["file_revise"]).where(F.col("size_class") != "ok")
    own = sized.where(~paths.is_generated(F.col("path")) & ~paths.basename(F.col("path")).startswith("test_"))
    return own.select(F.concat(F.lit("size."), "size_class").alias("check_id"), "path", F.lit(1).alias("line_no"), F.col("line_count").cast("string").alias("detail"), F.lit("MEDIUM").alias("severity"), F.lit("REVISE").alias("impact"))


def _named(rows: DataFrame, check: str, line, detail, severity: str = "MEDIUM") -> DataFrame:
    return rows.select(F.lit(check).alias("check_id"), "path", line.cast("int").alias("line_no"), detail.cast("string").alias("detail"), F.lit(severity).alias("severity"), F.lit("REVISE" if severity != "LOW" else "WARN").alias("impact"))


def _blocks(c: Context) -> DataFrame:
    merged = blocks.merged(c.lines)
    return _named(merged, "duplication.text_block", F.col("first_line"), F.concat_ws(" ", F.col("n_files").cast("string"), F.lit("files, lines to"), F.col("last_line").cast("string"))).unionByName(
        _named(blocks.within_file(c.lines), "duplication.text_block_intra", F.col("first_line"), F.concat_ws(" ", F.col("n").cast("string"), F.lit("places")))
    )


def _duplicates(c: Context) -> DataFrame:
    found = blocks.regions(c.lines)
    at = blocks.meaningful(c.lines).select("path", F.col("k").alias("start"), "line_no")
    return _named(found.join(at, ["path", "start"]), "duplicate_scan", F.col("line_no"), F.concat_ws(" ", F.col("n_lines").cast("string"), F.lit("lines")), "LOW")


def _renames(c: Context) -> DataFrame:
    names = c.facts.where("fact = 'symbol' AND scope = '' AND attrs['visibility'] = 'public'").where(~paths.is_test(F.col("path"))).select("name", "path").distinct()
    first = names.groupBy("name").agg(F.min("path").alias("path"))
    pairs = structure.near_names(first.select("name").where(~F.col("name").rlike(r"_v[0-9]+$")), 6).join(first, "name")
    other = first.select(F.col("name").alias("other"), F.col("path").alias("p2"))
    return _named(pairs.join(other, "other").where("path <> p2"), "refactor.partial_rename_candidate", F.lit(1), F.concat_ws(" / ", "name", "other"), "LOW")


def _lines(c: Context) -> DataFrame:
    hits = materialize(c.spark, line_checks.check_lines(c.lines), "line-hits")
    return hits.unionByName(_named(line_checks.too_many_todos(hits), "todo_scan", F.lit(1), F.concat_ws(" ", F.col("n").cast("string"), F.lit("markers"))))


def _syntax(c: Context) -> DataFrame:
    return fact_checks._found(c.facts.where((F.col("fact") == "syntax_error") & (paths.language(F.col("path")) != "python")), "syntax_validity.parse_error", F.col("name"), "CRITICAL", "BLOCK")


#: Gates: what each one runs, whether it runs by default, and what it needs.
GATES: dict[str, tuple[Callable[[Context], DataFrame], str]] = {
    "broad_except": (lambda c: fact_checks.handlers(c.facts), ""), "calls": (lambda c: fact_checks.calls(c.facts), ""), "functions": (lambda c: fact_checks.functions(c.facts, c.profile), ""),
    "names": (lambda c: fact_checks.names(c.facts, c.lines), ""), "atomic_write_safety": (lambda c: fact_checks.writes(c.facts), ""), "local_rules": (lambda c: fact_checks.local_hits(c.facts).where(F.col("check_id") != "god_object_zones.zone_inflation"), ""),
    "god_object_zones": (lambda c: fact_checks.local_hits(c.facts).where(F.col("check_id") == "god_object_zones.zone_inflation"), "opt_in"),
    "meta": (lambda c: fact_checks.too_deep(c.facts), ""), "hallucination": (lambda c: fact_checks.imported_names(c.facts, c.files), ""), "project_tests": (lambda c: fact_checks.project_tests(c.facts, c.files), ""),
    "normalized_functions": (lambda c: fact_checks.same_functions(c.facts, c.touched), ""), "syntax_validity": (_syntax, ""), "lines": (_lines, ""), "surroundings": (lambda c: text_checks.all_checks(c.lines), ""),
    "swift": (lambda c: other_languages.swift_checks(c.lines), ""), "size": (_sizes, ""), "duplication": (_blocks, ""), "duplicate_scan": (_duplicates, ""), "partial_rename": (_renames, ""),
    "encoding_scan": (lambda c: text_checks.encodings(c.raw), "raw"), "proliferation": (lambda c: corpus_checks.proliferation(c.files), ""), "generic_fork": (lambda c: corpus_checks.forked(c.files), ""),
    "file_proliferation": (lambda c: corpus_checks.copies(c.files, c.touched), ""), "unused_shim": (lambda c: corpus_checks.unused_shims(c.facts), ""), "http_methods": (lambda c: corpus_checks.http_methods(c.lines), ""),
    "abstraction_bypass": (lambda c: corpus_checks.bypassed(c.files, c.lines), ""), "parallel_flow": (lambda c: corpus_checks.parallel_flows(c.files, c.lines), ""), "empty_output": (lambda c: corpus_checks.empty_output(c.files), ""),
    "import_cycles": (lambda c: corpus_checks.import_cycles(c.spark, c.lines), ""),
    "shape_adapter": (lambda c: corpus_checks.shape_adapters(c.lines), ""), "js_coverage": (lambda c: corpus_checks.js_constants(c.lines, c.profile.get("checked_js", [])), ""), "response_shape": (lambda c: corpus_checks.response_shapes(c.lines), ""),
    "fallback": (lambda c: corpus_checks.fallbacks(c.files, c.profile.get("fallback_patterns", []), c.profile.get("critical_roots", [])), ""),
    "config_ssot": (lambda c: corpus_checks.config_owners(c.files, c.facts, c.profile.get("owners", {}), c.profile.get("env_keys", [])), ""),
    "performance": (lambda c: fact_checks.expensive_loops(c.facts, c.profile.get("sensitive_roots", [])), ""),
    "implementation_overfit": (lambda c: corpus_checks.own_literals(c.lines, c.profile.get("own_literals", []), c.profile.get("own_env_prefix", "")), ""),
    "contract_drift": (lambda c: fact_checks.against_previous(c.facts, c.before), "before"), "new_writers": (lambda c: fact_checks.new_writers(c.facts, c.before), "before"), "import_order": (lambda c: fact_checks.import_order(c.facts, c.before), "before"),
}


def disabled_gates(text: str | None) -> tuple[set[str], list[str]]:
    """Gates to leave out: a JSON list, or an object with the list `disabled`. What is malformed disables nothing and is reported."""
    if text is None:
        return set(), []
    try:
        got = json.loads(text)
        got = got["disabled"] if isinstance(got, dict) else got
        if not isinstance(got, list) or not all(isinstance(x, str) for x in got):
            raise ValueError("not a list of names")
    except (ValueError, KeyError) as e:
        return set(), [f"disabled gates: {e!r}"]
    return set(got), []


def resolve_gates(asked: list[str] | None = None, disabled: set[str] = frozenset(), have: set[str] = frozenset()) -> list[tuple[str, str]]:
    """(gate, state) of every gate: disabled, before lacking its input, before opt_in, before not asked for, else run."""
    out = []
    for name, (_, needs) in GATES.items():
        if name in disabled:
            state = "disabled"
        elif needs in ("raw", "before") and needs not in have:
            state = "no_input"
        elif needs == "opt_in" and name not in (asked or []):
            state = "opt_in"
        else:
            state = "run" if asked is None or name in asked else "not_in_filter"
        out.append((name, state))
    return out


def _meta(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Meta findings (check, detail, severity), each once."""
    return spark.createDataFrame([(c, "", 1, d, s, "REVISE") for c, d, s in dict.fromkeys(rows)], FOUND)


def run_gates(c: Context, names: list[str], at_once: int = 4) -> DataFrame:
    """The findings of gates, each in a job of its own; one that fails gives a finding internal_failure.<gate>, the others go on."""

    def one(name: str) -> DataFrame:
        try:
            found = GATES[name][0](c).select("check_id", "path", F.col("line_no").cast("int").alias("line_no"), "detail", "severity", "impact")
            return materialize(c.spark, found, f"gate-{name}")
        except Exception as e:  # one gate's failure is a finding
            return _meta(c.spark, [(f"internal_failure.{name}", f"{type(e).__name__}: {str(e)[:200]}", "HIGH")])

    with ThreadPoolExecutor(at_once) as pool:
        parts = list(pool.map(one, names))
    out = c.spark.createDataFrame([], FOUND)
    for p in parts:
        out = out.unionByName(p)
    return out


def context(spark: SparkSession, files: DataFrame, settings: dict | None = None, **more) -> Context:
    """files with their lines and facts, written once; facts in a folder for each kind, so that a check reads its own."""
    base = materialize(spark, files.select("path", "text", *([F.col("size")] if "size" in files.columns else [F.length("text").cast("long").alias("size")])), "files")
    made = python_facts.facts(base).unionByName(other_languages.facts(base))
    facts = materialize(spark, made, "facts", by="fact")
    return Context(spark, base, materialize(spark, tables.lines(base), "lines"), facts, settings or dict(DEFAULTS), **more)


def run_audit(
    spark: SparkSession, files: DataFrame, severity: str = "LOW", most_files: int | None = None, allowlist: DataFrame | None = None, now: str = "", checks: list[str] | None = None,
    gates: list[str] | None = None, disabled: str | None = None, settings: str | None = None, raw: DataFrame | None = None, touched: DataFrame | None = None, before: DataFrame | None = None,
) -> DataFrame:
    """Findings of the gates over files, suppressed and allowlisted ones left out, at or above the severity. With over
    `most_files` files the answer is an error with the folders that hold most."""
    if most_files is not None and (top := tables.too_many(files, most_files).collect()):
        raise ValueError("too many files: " + ", ".join(f"{r['dir']} {r['n']}" for r in top))
    prof, wrong = profile(settings)
    off, wrong2 = disabled_gates(disabled)
    old = materialize(spark, python_facts.facts(before), "facts-before", by="fact") if before is not None else None
    c = context(spark, files, prof, raw=raw, touched=touched, before=old)
    have = {n for n, x in (("raw", raw), ("before", before)) if x is not None}
    found = run_gates(c, [g for g, state in resolve_gates(gates, off, have) if state == "run"])
    if wrong or wrong2:
        found = found.unionByName(_meta(spark, [("meta.malformed_settings", x, "HIGH") for x in wrong + wrong2]))
    found = report.identified(found).dropDuplicates(["check_id", "path", "line_no", "detail"])
    if checks is not None:
        found = found.where(found["check_id"].isin(*checks))
    found = report.floor(report.suppressed(found, c.lines), severity)
    return found if allowlist is None else report.allowed(found, allowlist, files, now)


def exit_code(findings: DataFrame) -> int:
    """1 if there is a high or critical finding, else 0."""
    return int(not findings.where(F.col("severity").isin("HIGH", "CRITICAL")).isEmpty())


def run_maps(spark: SparkSession, files: DataFrame, seed: list[dict] | None = None, churn: DataFrame | None = None, runtime_seed: DataFrame | None = None, previous_conflicts: DataFrame | None = None, previous_findings: DataFrame | None = None) -> dict[str, DataFrame]:
    """The eight maps by name. Facts are extracted once; maps that others read are written in the shared folder."""
    files = materialize(spark, files.select("path", "text"), "files")
    facts = materialize(spark, python_facts.facts(files).unionByName(other_languages.facts(files)), "facts", by="fact")
    s = materialize(spark, maps.structural(spark, files, facts), "structural")
    r = materialize(spark, maps.runtime(facts, runtime_seed), "runtime")
    c = materialize(spark, maps.contracts(facts), "contracts")
    a = materialize(spark, maps.authority(facts, seed), "authority")
    conf = maps.guard_conflicts(materialize(spark, maps.conflicts(spark, s, r, c, a, previous_conflicts), "conflicts"))
    hot = materialize(spark, maps.hotspots(s, r, c, a, conf, churn), "hotspots")
    return {"structural": s, "runtime": r, "data_contract": c, "authority": a, "conflict": conf, "hotspot": hot, "refactor_boundary": maps.boundaries(conf, hot), "findings": maps.findings(s, r, c, a, conf, hot, previous_findings)}


def cycle_groups(spark: SparkSession, structural: DataFrame) -> DataFrame:
    """(file, group) of files whose cycle lists overlap, directly or through others."""
    edges = structural.where("size(cycles) > 0").select(F.col("file").alias("src"), F.explode("cycles").alias("dst")).where("src <> dst")
    both = edges.union(edges.select("dst", "src"))
    return graph.components(spark, both).select(F.col("node").alias("file"), F.col("component").alias("group"))
