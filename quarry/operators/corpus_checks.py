"""Checks across files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.operators import graph
from quarry.session import materialize

# Fixed values of the checks, by language where it matters.
GENERIC = {
    "python": ["utils", "helpers", "common", "shared", "misc", "tools", "util", "helper", "support", "base"],
    "javascript": ["utils", "helpers", "common", "shared", "base", "lib", "index", "constants"],
    "go": ["utils", "helpers", "common", "internal", "util"],
    "java": ["Utils", "Helper", "Common", "Shared", "Base", "Util", "Helpers"],
    "swift": ["Utils", "Helpers", "Common", "Shared", "Extensions", "Util", "Helper", "Constants"],
}
SHARED = {
    "python": ["shared", "utils", "common", "helpers", "base", "lib", "core"],
    "javascript": ["shared", "utils", "common", "helpers", "base", "lib", "core", "services"],
    "go": ["internal", "common", "shared", "helpers", "util"],
    "java": ["utils", "common", "shared", "base", "helper"],
    "swift": ["shared", "common", "utils", "helpers", "extensions", "core"],
}
#: Patterns that mark the steps of a flow.
MARKERS = {
    "python": ["def build_", "def create_", "def run_", "def execute_", "subprocess", r"json\.loads", r"json\.dumps"],
    "javascript": ["function build", "function create", "async function", r"fetch\(", r"JSON\.parse", r"JSON\.stringify"],
}
for _table in (GENERIC, SHARED, MARKERS):
    _table["typescript"] = _table["javascript"]
SUFFIXES = ["_checks", "_check", "_utils", "_helpers", "_handlers", "_runners", "_providers", "_adapters", "_validators"]
PROVIDERS = r"(_provider|_adapter|_service|_client|_backend|_engine)\.(py|ts|js)$"
COPIES = r"_v\d+|_new|_copy|_backup|_old|_fixed|_updated|_refactored|_alt|\.bak|\.orig|\.copy"
#: Modules of an import cycle that a finding names; it counts all.
NAMED = 20
FIX_WORDS = r"(?i)\b(fix|bug|bugfix|hotfix|regression|repair)"


def _listed(table: dict[str, list[str]], word: Column) -> Column:
    """The word is in its language's list; language(path) is a column `lang`."""
    out = F.lit(False)
    for lang, words in table.items():
        out = out | ((F.col("lang") == lang) & word.isin(*words))
    return out


def _found(rows: DataFrame, check: str, detail: Column, severity: str = "MEDIUM", impact: str = "REVISE") -> DataFrame:
    return rows.select(F.lit(check).alias("check_id"), "path", F.lit(1).alias("line_no"), detail.alias("detail"), F.lit(severity).alias("severity"), F.lit(impact).alias("impact"))


def _stems(files: DataFrame) -> DataFrame:
    p = F.col("path")
    return files.select("path", F.lower(paths.stem(p)).alias("stem"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.length("text").alias("n"), paths.basename(p).alias("base"), paths.language(p).alias("lang"))


def proliferation(files: DataFrame, least: int = 3) -> DataFrame:
    """c52.responsibility_proliferation: files of one folder with the same suffix."""
    s = _stems(files).withColumn("suffix", F.coalesce(*[F.when(F.col("stem").endswith(x), F.lit(x)) for x in SUFFIXES])).where("suffix IS NOT NULL")
    by = s.groupBy("dir", "suffix").agg(F.count("*").alias("k"), F.min("path").alias("path")).where(F.col("k") >= least)
    return _found(by, "c52.responsibility_proliferation", F.concat_ws(" ", "dir", "suffix", F.col("k").cast("string")))


def _elsewhere(stems: DataFrame) -> DataFrame:
    """(stem, a, a_dir, a_n, b, b_dir, b_n): of each stem the first files of its two first folders, so that every file finds
    one in another folder without a join of all files of a stem."""
    firsts = stems.groupBy("stem", "dir").agg(F.min(F.struct("path", "dir", "n")).alias("f"))
    w = W.partitionBy("stem").orderBy("f.path")
    two = firsts.withColumn("k", F.row_number().over(w)).where("k <= 2")
    return two.groupBy("stem").agg(F.max(F.when(F.col("k") == 1, F.col("f"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("f"))).alias("b"))


def _imported_words(lines: DataFrame) -> DataFrame:
    """(path, word): parts of dotted names after import or from."""
    names = F.regexp_extract_all("line", F.lit(r"(?:from|import)\s+([\w.]+)"), F.lit(1))
    return lines.where(F.col("line").rlike("import|from")).select("path", F.explode(names).alias("name")).select("path", F.explode(F.split(F.lower("name"), r"\.")).alias("stem")).distinct()


def bypassed(files: DataFrame, lines: DataFrame) -> DataFrame:
    """c52.abstraction_bypass: a file with the stem of a shared family that another file has too, which it doesn't import."""
    s = _stems(files.where("trim(text) <> ''"))
    # Of each stem the two first files: one of them is another than the row's.
    two = _stems(files).groupBy("stem").agg(F.min("path").alias("a"), F.max("path").alias("z"))
    hit = s.where(_listed(SHARED, F.col("stem"))).join(two, "stem").where("a <> z").withColumn("hub", F.when(F.col("a") != F.col("path"), F.col("a")).otherwise(F.col("z")))
    return _found(hit.join(_imported_words(lines), ["path", "stem"], "left_anti"), "c52.abstraction_bypass", F.col("hub"))


def parallel_flows(files: DataFrame, lines: DataFrame, least: int = 3) -> DataFrame:
    """c52.provider_parallel_flow: provider files that share three flow markers with another one, where neither imports the
    other; a row for each such file, with the number of its partners and the first of them.

    The markers of a language are few, so files fall into at most 128 classes by the markers they hold; classes are compared
    with classes, and the pairs that import one another are taken off."""
    own = files.where(F.col("path").rlike(PROVIDERS)).withColumn("lang", paths.language(F.col("path")))
    mask = F.lit(0)
    for lang in ("python", "javascript", "typescript"):
        for i, m in enumerate(MARKERS[lang]):
            mask = mask + F.when((F.col("lang") == lang) & F.col("text").rlike(m), 1 << i).otherwise(0)
    p = own.select("path", F.when(F.col("lang") == "python", "py").otherwise("js").alias("family"), F.lower(paths.stem(F.col("path"))).alias("stem"), mask.alias("mask"))
    classes = p.groupBy("family", "mask").agg(F.count("*").alias("k"), F.min("path").alias("a"), F.max("path").alias("z"))
    enough = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.col(y))) >= least
    other = classes.select("family", F.col("mask").alias("m2"), "k", "a", "z")
    near = p.select("family", "mask").distinct().join(F.broadcast(other), "family").where(enough("mask", "m2"))
    words = _imported_words(lines)
    # (a, b) where a imports b's stem, in either direction: imports of provider stems only.
    to = words.join(p.select("stem", F.col("path").alias("b"), F.col("mask").alias("mb"), F.col("family").alias("fb")), "stem").join(p.select("path", F.col("mask").alias("ma"), F.col("family").alias("fa")), "path").where((F.col("fa") == F.col("fb")) & (F.col("path") != F.col("b")) & enough("ma", "mb"))
    linked = to.select(F.least("path", "b").alias("l"), F.greatest("path", "b").alias("r")).distinct()
    off = linked.select(F.col("l").alias("path")).union(linked.select("r")).groupBy("path").agg(F.count("*").alias("off"))
    count = p.join(near, ["family", "mask"]).groupBy("path").agg(
        (F.sum("k") - F.max(F.when(F.col("mask") == F.col("m2"), 1).otherwise(0))).alias("n"), F.min(F.when(F.col("a") != F.col("path"), F.col("a")).otherwise(F.when(F.col("z") != F.col("path"), F.col("z")))).alias("first")
    )
    left = count.join(off, "path", "left").withColumn("n", F.col("n") - F.coalesce("off", F.lit(0))).where("n >= 1")
    return _found(left, "c52.provider_parallel_flow", F.concat_ws(" ", F.col("n").cast("string"), F.lit("partners, near"), "first"))


def forked(files: DataFrame, least: int = 200) -> DataFrame:
    """c52.generic_shared_fork: a file of a generic name whose name stands in another folder too, both of some length."""
    all_ = _stems(files.where("trim(text) <> ''"))
    s = all_.withColumn("own", paths.stem(F.col("path"))).where(_listed(GENERIC, F.col("own")) | _listed(GENERIC, F.col("stem")))
    hit = s.join(_elsewhere(all_), "stem").withColumn("other", F.when(F.col("a.dir") != F.col("dir"), F.col("a")).otherwise(F.col("b"))).where("other IS NOT NULL")
    return _found(hit.where(F.least("n", "other.n") >= least), "c52.generic_shared_fork", F.col("other.path"))


def copies(files: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """file_proliferation of the new files (path; all if not given): a copy's name whose original is in the tree, a generic name
    beside another in one folder, a name that another folder has too."""
    all_ = _stems(files)
    s = all_ if new is None else all_.join(new.select("path").distinct(), "path", "left_semi")
    ext = paths.extension(F.col("path"))
    origin = s.withColumn("origin", F.concat(F.regexp_replace(paths.stem(F.col("path")), COPIES, ""), F.lit("."), ext)).where("origin <> base")
    clone = origin.join(all_.select(F.col("base").alias("origin")).distinct(), "origin", "left_semi")
    generic = all_.where(_listed(GENERIC, F.col("stem"))).groupBy("dir").agg(F.count("*").alias("k")).where("k >= 2")
    helper = s.where(_listed(GENERIC, F.col("stem"))).join(generic, "dir")
    twice = all_.groupBy("base").agg(F.countDistinct("dir").alias("k")).where("k >= 2")
    shadow = s.where(~F.col("base").isin("__init__.py", "index.js", "index.ts", "main.go")).join(twice, "base")
    return (
        _found(clone, "file_proliferation.clone_naming", F.col("origin"), "HIGH")
        .unionByName(_found(helper, "file_proliferation.generic_helper", F.concat_ws(" ", F.col("k").cast("string"), F.lit("in"), "dir")))
        .unionByName(_found(shadow, "file_proliferation.shadow_file", F.col("base"), "LOW", "WARN"))
    )


def empty_output(files: DataFrame) -> DataFrame:
    """empty_output.zero_bytes: files of no bytes, but for package markers."""
    keep = paths.basename(F.col("path")).isin("__init__.py", ".gitkeep", "py.typed")
    return _found(files.where((F.coalesce("size", F.length("text").cast("long")) == 0) & ~keep), "empty_output.zero_bytes", F.lit("0 bytes"), "HIGH")


def fallbacks(files: DataFrame, patterns: list[str], critical: list[str] | None = None) -> DataFrame:
    """fallback.pattern: files that hold one of the profile's patterns, in any case; HIGH under a critical root."""
    hit = F.array_compact(F.array(*[F.when(F.lower("text").contains(p.lower()), F.lit(p)) for p in patterns])) if patterns else F.array().cast("array<string>")
    root = F.lit(False)
    for r in critical or []:
        root = root | F.col("path").startswith(r)
    rows = files.select("path", F.explode(hit).alias("p"))
    return _found(rows.where(root), "fallback.pattern", F.col("p"), "HIGH").unionByName(_found(rows.where(~root), "fallback.pattern", F.col("p")))


def config_owners(files: DataFrame, facts: DataFrame, owners: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """config_ssot: a canonical literal outside its owners' files; listed environment keys read outside configuration files."""
    own = F.array_compact(F.array(*[F.when(F.col("text").contains(lit) & ~F.col("path").isin(*who), F.lit(lit)) for lit, who in owners.items()])) if owners else F.array().cast("array<string>")
    literal = _found(files.select("path", F.explode(own).alias("l")), "config_ssot.literal_owner", F.col("l"))
    env = facts.where((F.col("fact") == "env") & F.col("name").isin(*(keys or [""])) & ~paths.basename(F.col("path")).rlike("(?i)config|settings|env"))
    return literal.unionByName(_found(env, "config_ssot.env_bypass", F.col("name")).withColumn("line_no", F.lit(1)))


def shape_adapters(lines: DataFrame) -> DataFrame:
    """legacy_compat_debt.shape_adapter_without_producer: `if "old" in d: d["new"] = d.pop("old")` or the like, where no
    other file quotes the old key."""
    q = r"""["'](\w+)["']"""
    old = F.regexp_extract("line", rf"\[{q}\]\s*=\s*\w+\.(?:pop|get)\(\s*{q}", 2)
    adapters = lines.withColumn("key", old).where("key <> ''").select("path", "line_no", "key")
    said = lines.where(F.col("line").rlike(q)).select("path", F.explode(F.regexp_extract_all("line", F.lit(q), F.lit(1))).alias("key")).groupBy("key").agg(F.min("path").alias("a"), F.max("path").alias("z"))
    alone = adapters.join(said, "key").where("a = z")
    return alone.select(F.lit("legacy_compat_debt.shape_adapter_without_producer").alias("check_id"), "path", "line_no", F.col("key").alias("detail"), F.lit("MEDIUM").alias("severity"), F.lit("REVISE").alias("impact"))


def js_constants(lines: DataFrame, checked: list[str]) -> DataFrame:
    """js_coverage_scan: constants of embedded scripts (NAME_JS) that nothing checks."""
    name = F.regexp_extract("line", r"^_?([A-Z][A-Z0-9_]*_JS)\s*=", 1)
    rows = lines.withColumn("name", name).where((F.col("name") != "") & ~F.col("name").isin(*(checked or [""])))
    return rows.select(F.lit("js_coverage_scan").alias("check_id"), "path", "line_no", F.col("name").alias("detail"), F.lit("MEDIUM").alias("severity"), F.lit("REVISE").alias("impact"))


def response_shapes(lines: DataFrame) -> DataFrame:
    """response_shape_scan: fields that scripts read of a response and that no Python file has as a key."""
    js = lines.where(paths.language(F.col("path")).isin("javascript", "typescript"))
    field = js.select("path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"\b(?:data|response|resp|result|payload)\.([a-z]\w*_\w+)\b(?!\s*\()"), F.lit(1))).alias("key"))
    keys = lines.where(paths.language(F.col("path")) == "python").select(F.explode(F.regexp_extract_all("line", F.lit(r"""["'](\w+)["']\s*:|(\w+)\s*="""), F.lit(0))).alias("k")).select(F.regexp_replace("k", r"\W", "").alias("key")).distinct()
    rows = field.join(keys, "key", "left_anti").distinct()
    return rows.select(F.lit("response_shape_scan").alias("check_id"), "path", "line_no", F.col("key").alias("detail"), F.lit("MEDIUM").alias("severity"), F.lit("REVISE").alias("impact"))


def own_literals(lines: DataFrame, patterns: list[str], env_prefix: str = "") -> DataFrame:
    """implementation_overfit: literals of one's own repository (patterns) and settings of one's own prefix, in code meant for
    any project; helpers called generic that hold such a literal."""
    code = lines.where(~F.ltrim("line").startswith("#"))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("line").rlike(p)
    row = lambda df, check: df.select(F.lit(check).alias("check_id"), "path", "line_no", F.trim("line").alias("detail"), F.lit("MEDIUM").alias("severity"), F.lit("REVISE").alias("impact"))
    out = row(code.where(hit), "implementation_overfit.hardcoded_repo_path")
    w = W.partitionBy("path").orderBy("line_no")
    head = F.last(F.when(F.col("line").rlike(r"^\s*(async\s+)?def\s"), F.col("line")), ignorenulls=True).over(w)
    fake = code.withColumn("head", head).withColumn("hit", hit).where(F.col("hit") & F.col("head").rlike(r"def\s+(generic_|universal_|common_)"))
    out = out.unionByName(row(fake.drop("head", "hit"), "implementation_overfit.fake_generic_helper"))
    if env_prefix:
        out = out.unionByName(row(code.where(F.col("line").rlike(rf"""os\.environ(?:\.get)?\s*[\(\[]\s*["']{env_prefix}""")), "implementation_overfit.env_tight_coupling"))
    return out


def import_cycles(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """import_cycle_scan: Python modules that lead back to themselves by lines `from .x` or `from a.b import` at the margin,
    the dot being the module's own folder. A finding for each set of modules that reach one another, at the first such import
    of its least module; a module that imports itself is a set of one."""
    module = F.regexp_replace(F.translate("path", "/\\", ".."), r"\.py$", "")
    near, far = F.regexp_extract("line", r"^from\s+\.(\w+)", 1), F.regexp_extract("line", r"^from\s+([\w.]+)\s+import", 1)
    beside = F.concat(F.regexp_replace(module, r"(^|\.)[^.]*$", ""), F.lit("."), near)
    rows = lines.where((paths.language(F.col("path")) == "python") & F.col("line").startswith("from"))
    said = rows.select("path", "line_no", module.alias("src"), F.when(near != "", beside).otherwise(far).alias("dst")).where("dst <> ''")
    edges = materialize(spark, said.join(said.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"), "module-edges")
    member = materialize(spark, graph.components(spark, edges.select("src", "dst")), "module-cycles")
    first = member.withColumn("nth", F.row_number().over(W.partitionBy("component").orderBy("node"))).where(F.col("nth") <= NAMED)
    names = first.groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("node")), ", ").alias("names")).join(member.groupBy("component").agg(F.count("*").alias("n")), "component")
    inside = edges.join(member.select(F.col("node").alias("dst"), "component"), "dst").where("src = component")
    at = inside.groupBy("component").agg(F.min(F.struct("path", "line_no")).alias("at"))
    detail = F.concat(F.col("n").cast("string"), F.lit(" modules: "), "names")
    return names.join(at, "component").select(F.lit("import_cycle_scan").alias("check_id"), "at.path", "at.line_no", detail.alias("detail"), F.lit("HIGH").alias("severity"), F.lit("REVISE").alias("impact"))


def unused_shims(facts: DataFrame) -> DataFrame:
    """unused_shim_module: Python modules of imports only that no other file outside the tests imports."""
    facts = facts.where(F.col("path").endswith(".py"))
    code = facts.where("fact IN ('function', 'call', 'assign', 'contract') AND name <> '__all__'").select("path").distinct()
    shim = facts.where("fact = 'import'").select("path").distinct().join(code, "path", "left_anti").where(paths.basename(F.col("path")) != "__init__.py").withColumn("stem", paths.stem(F.col("path")))
    users = facts.where("fact = 'import'").where(~paths.is_test(F.col("path"))).select(F.col("path").alias("user"), F.explode(F.split("name", r"\.")).alias("stem")).distinct()
    return _found(shim.alias("s").join(users.alias("u"), (F.col("s.stem") == F.col("u.stem")) & (F.col("s.path") != F.col("u.user")), "left_anti"), "unused_shim_module", F.col("stem"), "LOW", "WARN")


def http_methods(lines: DataFrame) -> DataFrame:
    """method_match_scan: a fetch whose method no route of that url has."""
    routes = lines.withColumn("m", F.upper(F.regexp_extract("line", r"""\.(get|post|put|patch|delete)\s*\(\s*["'](/[^"']*)["']""", 1))).withColumn("url", F.regexp_extract("line", r"""\.(get|post|put|patch|delete)\s*\(\s*["'](/[^"']*)["']""", 2)).where("url <> ''").select("url", F.col("m").alias("route")).distinct()
    pattern = r"""fetch\s*\(\s*["'`](/[^"'`]*)["'`](?:.*method\s*:\s*["'](\w+)["'])?"""
    calls = lines.withColumn("url", F.regexp_extract("line", pattern, 1)).where("url <> ''").withColumn("m", F.upper(F.coalesce(F.nullif(F.regexp_extract("line", pattern, 2), F.lit("")), F.lit("GET"))))
    known = calls.join(routes.select("url").distinct(), "url", "left_semi").join(routes.withColumnRenamed("route", "m"), ["url", "m"], "left_anti")
    return known.select(F.lit("method_match_scan").alias("check_id"), "path", "line_no", F.concat_ws(" ", "m", "url").alias("detail"), F.lit("HIGH").alias("severity"), F.lit("REVISE").alias("impact"))


def vulnerabilities(audit: DataFrame) -> DataFrame:
    """dependency_cve_scan over rows (json) of a package audit: name, version and ids of each vulnerable dependency."""
    d = audit.select(F.explode(F.from_json("json", "dependencies array<struct<name:string,version:string,vulns:array<struct<id:string,fix_versions:array<string>>>>>")["dependencies"]).alias("d"))
    return d.select("d.name", "d.version", F.explode("d.vulns").alias("v")).select("name", "version", F.col("v.id").alias("vuln"), F.array_join("v.fix_versions", ",").alias("fixed_in"))


def broken_imports(lines: DataFrame, gone: DataFrame) -> DataFrame:
    """import_integrity.broken_import: lines that still import a module that is gone (module)."""
    named = lines.withColumn("module", F.regexp_extract("line", r"^\s*(?:from|import)\s+([A-Za-z_][\w.]*)", 1)).where("module <> ''")
    hit = named.join(gone.select("module").distinct(), "module", "left_semi")
    return hit.select(F.lit("import_integrity.broken_import").alias("check_id"), "path", "line_no", F.col("module").alias("detail"), F.lit("HIGH").alias("severity"), F.lit("BLOCK").alias("impact"))


def outside_boundaries(changed: DataFrame, boundaries: DataFrame) -> DataFrame:
    """boundary_breach.file_outside_all_boundaries: changed files that no boundary allows, by path or by glob, where there is a boundary."""
    allowed = boundaries.select(F.explode("allowed_files").alias("g")).distinct()
    exact = changed.join(allowed.select(F.col("g").alias("path")), "path", "left_anti")
    # Globs are turned into patterns in Spark; those with a wildcard are few.
    parts = F.regexp_replace(F.regexp_replace("g", r"([.+^$(){}|\[\]\\])", r"\\$1"), r"\?", ".")
    pattern = F.regexp_replace(F.regexp_replace(F.regexp_replace(parts, r"\*\*/", "\u0001"), r"\*+", ".*"), "\u0001", "(?:.*/)?")
    globs = allowed.where(F.col("g").rlike(r"[*?]")).select(F.concat(F.lit("^"), pattern, F.lit("$")).alias("re"))
    left = exact.join(globs, F.regexp_like("path", F.col("re")), "left_anti")
    some = boundaries.limit(1).select(F.lit(True).alias("some"))
    return _found(left.join(F.broadcast(some)), "boundary_breach.file_outside_all_boundaries", F.col("path"), "HIGH")


def conflict_touch(changed: DataFrame, conflicts: DataFrame) -> DataFrame:
    """conflict_touch.unresolved_high_conflict: changed files of open high conflicts."""
    hot = conflicts.where("conflict_status = 'open' AND severity IN ('high', 'critical')").select(F.explode("files").alias("path"), "conflict_id").groupBy("path").agg(F.min("conflict_id").alias("conflict_id"))
    return _found(changed.join(hot, "path"), "conflict_touch.unresolved_high_conflict", F.col("conflict_id"), "HIGH")


def hotspot_inflation(touched: DataFrame, hotspots: DataFrame) -> DataFrame:
    """hotspot_inflation: touched files that should not be."""
    j = touched.join(hotspots.select(F.col("target").alias("path"), "recommended_mode"), "path")
    return _found(j.where("recommended_mode = 'do_not_touch'"), "hotspot_inflation", F.col("recommended_mode"), "HIGH").unionByName(_found(j.where("recommended_mode = 'forensic_first'"), "hotspot_inflation", F.col("recommended_mode")))
