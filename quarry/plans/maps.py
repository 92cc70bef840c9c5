"""The eight maps as plans over files and facts.

structural, runtime, data contracts and authority come from facts; conflicts join those; hotspots score files from all of
them; refactor boundaries and findings follow from conflicts and hotspots. Previous conflicts and findings give lifecycles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.operators import graph, report, structure
from quarry.operators.fact_checks import _of, attr
from quarry.sources import other_languages

LARGE, FAN_IN, FAN_OUT = 1200, 10, 15
#: Most open conflicts that make sense; more are an error.
MOST_CONFLICTS = 500


def resolve_imports(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) of imports that name a file of the tree: a/b.py, else a/b/__init__.py; leading dots go up from the importer."""
    i = _of(facts, "import").where((attr("kind") != "dynamic") & F.col("path").rlike(r"\.pyi?$")).select(F.col("path").alias("src"), "name").distinct()
    dots = F.length(F.regexp_extract("name", r"^\.+", 0))
    folder = F.slice(F.split("src", "/"), 1, F.greatest(F.size(F.split("src", "/")) - F.greatest(dots, F.lit(1)), F.lit(0)))
    rest = F.regexp_replace(F.regexp_replace("name", r"^\.+", ""), r"\.", "/")
    base = F.when(dots > 0, F.concat_ws("/", F.array_join(folder, "/"), F.nullif(rest, F.lit("")))).otherwise(rest)
    base = F.regexp_replace(base, "^/", "")
    tries = i.select("src", "name", F.posexplode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))).alias("pos", "dst"))
    hit = tries.join(files.select(F.col("path").alias("dst")), "dst")
    python = hit.groupBy("src", "name").agg(F.min_by("dst", "pos").alias("dst")).where("src <> dst").select("src", "dst")
    scripts = other_languages.resolve_relative(_of(facts, "import").where(paths.language(F.col("path")).isin("javascript", "typescript")).select("path", "name"), files)
    return python.union(scripts.where("src <> dst")).distinct()


def structural(spark: SparkSession, files: DataFrame, facts: DataFrame) -> DataFrame:
    """A row for each file: imports out and in, symbols, cycle, tags."""
    edges = resolve_imports(facts, files)
    out = _of(facts, "import").groupBy(F.col("path").alias("file")).agg(F.array_sort(F.collect_set("name")).alias("imports_out"))
    into = edges.groupBy(F.col("dst").alias("file")).agg(F.array_sort(F.collect_set("src")).alias("imports_in"))
    symbols = _of(facts, "symbol").groupBy(F.col("path").alias("file")).agg(F.array_sort(F.collect_set("name")).alias("symbols_defined"))
    broken = _of(facts, "syntax_error").select(F.col("path").alias("file"), F.lit(True).alias("broken"))
    scc = graph.components(spark, edges).withColumnRenamed("node", "file")
    members = scc.groupBy("component").agg(F.array_sort(F.collect_set("file")).alias("cycle"))
    cycles = scc.join(members, "component").select("file", "component", "cycle")
    none = F.array().cast("array<string>")
    j = files.select(F.col("path").alias("file"), paths.language(F.col("path")).alias("language"), F.coalesce(F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n")), F.lit(0)).alias("size_lines"))
    for t in (out, into, symbols, broken, cycles):
        j = j.join(t, "file", "left")
    fan_in, fan_out = F.size(F.coalesce("imports_in", none)), F.size(F.coalesce("imports_out", none))
    tags = F.array_compact(F.array(F.when(F.col("cycle").isNotNull(), "cycle_member"), F.when(fan_in > FAN_IN, "fan_in"), F.when(fan_out > FAN_OUT, "fan_out"), F.when(F.col("size_lines") > LARGE, "large_file"), F.when(F.col("broken"), "unparseable")))
    return j.select("file", "language", "size_lines", F.coalesce("imports_out", none).alias("imports_out"), F.coalesce("imports_in", none).alias("imports_in"), F.coalesce("symbols_defined", none).alias("symbols_defined"), "component", F.coalesce("cycle", none).alias("cycles"), tags.alias("tags"))


def runtime(facts: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """Nodes: entry points, side effects at import, decorator registries, env reads; merged by node, seeds first."""
    parts = [
        _of(facts, "main").select(F.concat("path", F.lit("::__main__")).alias("node"), "path", F.lit("main_entrypoint").alias("kind"), F.lit(None).cast("string").alias("effect"), F.lit(None).cast("string").alias("env"), "line"),
        _of(facts, "side_effect").select(F.concat("path", F.lit("::import")).alias("node"), "path", F.lit("import_time_side_effect"), F.col("name"), F.lit(None).cast("string"), "line"),
        _of(facts, "function").where(F.col("name").isin("main", "run", "serve", "start") & (F.col("scope") == "")).select(F.concat("path", F.lit("::"), "name"), "path", F.lit("entry_function"), F.lit(None).cast("string"), F.lit(None).cast("string"), "line"),
        _of(facts, "decorator").where(F.col("name").rlike(r"(\.|^)(route|get|post|command|register|task|on_event|hook|fixture)$")).select(F.concat("path", F.lit("::"), attr("of")), "path", F.lit("decorator_registry"), F.col("name"), F.lit(None).cast("string"), "line"),
        _of(facts, "call").where(F.col("name").rlike(r"(Thread|create_task|Process|apply_async|submit)$")).select(F.concat("path", F.lit("::"), F.coalesce(F.nullif("scope", F.lit("")), F.lit("import"))), "path", F.lit("background_task"), F.col("name"), F.lit(None).cast("string"), "line"),
        _of(facts, "env").select(F.concat("path", F.lit("::"), F.coalesce(F.nullif("scope", F.lit("")), F.lit("import"))), "path", F.lit("env_read"), F.lit(None).cast("string"), F.col("name"), "line"),
    ]
    raw = reduce(DataFrame.union, parts)
    if seed is not None:
        raw = raw.join(seed.select("node"), "node", "left_anti")
    made = raw.groupBy("node").agg(
        F.min("path").alias("defined_in"), F.min_by("kind", "line").alias("kind"), F.array_sort(F.collect_set("effect")).alias("side_effects"), F.array_sort(F.collect_set("env")).alias("depends_on_env"), F.array_sort(F.collect_set("kind")).alias("tags")
    )
    made = made.withColumn("confidence", F.lit(0.7)).withColumn("status", F.lit("inferred"))
    return made if seed is None else seed.select("node", "defined_in", "kind", "side_effects", "depends_on_env", "tags", F.lit(1.0).alias("confidence"), F.lit("canonical").alias("status")).unionByName(made)


def traced(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Inferred nodes that the trace events (name) saw become observed, their confidence 0.1 higher."""
    seen = events.select(F.col("name").alias("short")).distinct().withColumn("seen", F.lit(True))
    j = nodes.withColumn("short", F.element_at(F.split("node", "::"), -1)).join(seen, "short", "left")
    hit = F.coalesce("seen", F.lit(False)) & (F.col("status") == "inferred")
    return j.withColumn("confidence", F.when(hit, F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence"))).withColumn("status", F.when(hit, "observed").otherwise(F.col("status"))).drop("short", "seen")


def contracts(facts: DataFrame) -> DataFrame:
    """Entities by name: the canonical definition (smallest path), variants, writers, readers, drift flags."""
    c = _of(facts, "contract").select(F.col("name").alias("entity"), "path", F.map_from_entries(F.transform("items", lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)), F.regexp_replace(x, "^[^:]*:", "")))).alias("shape"))
    variants = F.array_sort(F.collect_list(F.struct("path", F.to_json("shape").alias("shape"))))
    first = c.groupBy("entity").agg(F.min("path").alias("canonical_path"), F.min_by("shape", "path").alias("canonical"), F.count("*").alias("n_variants"), variants.alias("variants"))
    v = c.join(first.select("entity", "canonical_path", "canonical"), "entity").where("path <> canonical_path")
    extra, missing = F.array_except(F.map_keys("shape"), F.map_keys("canonical")), F.array_except(F.map_keys("canonical"), F.map_keys("shape"))
    other = F.filter(F.array_intersect(F.map_keys("shape"), F.map_keys("canonical")), lambda k: F.col("shape")[k] != F.col("canonical")[k])
    flag = lambda what, xs: F.transform(xs, lambda x: F.concat(F.lit(what), F.col("path"), F.lit(":"), x))
    flags = v.select("entity", F.explode(F.concat(flag("extra:", extra), flag("missing:", missing), flag("annotation:", other))).alias("flag")).groupBy("entity").agg(F.array_sort(F.collect_set("flag")).alias("drift_flags"))
    names = first.select("entity")
    writers = _of(facts, "call").select(F.element_at(F.split("name", r"\."), -1).alias("entity"), "path").join(names, "entity").groupBy("entity").agg(F.array_sort(F.collect_set("path")).alias("writers"))
    readers = _of(facts, "import").where(attr("kind") == "member").select(F.element_at(F.split("name", r"\."), -1).alias("entity"), "path").join(names, "entity").groupBy("entity").agg(F.array_sort(F.collect_set("path")).alias("readers"))
    none = F.array().cast("array<string>")
    j = first.join(flags, "entity", "left").join(writers, "entity", "left").join(readers, "entity", "left")
    return j.select("entity", "canonical_path", F.to_json("canonical").alias("canonical_schema"), "variants", "n_variants", *[F.coalesce(x, none).alias(x) for x in ("writers", "readers", "drift_flags")])


def normal_target(col: str) -> Column:
    return F.regexp_replace(F.regexp_replace(col, r"[.-][0-9a-f]{8,}(?:-[0-9a-f]{4,})*\.tmp$", ""), r"\.(tmp|bak|backup|temp)$", "")


def authority(facts: DataFrame, seed: list[dict] | None = None) -> DataFrame:
    """(authority_domain, target, writer, kind, role, line): seeded domains with canonical and illegal writers, and targets
    that writers of two roots or more share; without seeds also each writer's own domain."""
    w = _of(facts, "write").select(normal_target("name").alias("target"), F.col("path").alias("writer"), attr("kind").alias("operation"), attr("provenance").alias("provenance"), "line").withColumn("role", paths.role(F.col("writer")))
    strength = F.array_position(F.array(*map(F.lit, ["unknown", "function_parameter", "string_literal", "path_constructor"])), F.col("provenance"))
    best = w.groupBy("target", "writer", "role").agg(F.max_by(F.struct("line", "operation", "provenance"), F.struct(strength, -F.col("line"))).alias("b")).select("target", "writer", "role", "b.*")
    known = best.where("target <> ''")
    parts = []
    for d in seed or []:
        hit = reduce(lambda a, b: a | b, [F.col("target").rlike(paths.glob_regex(g)) for g in d.get("target_file_patterns", [])], F.lit(False))
        ok = F.col("writer").isin(*(d.get("allowed_writers") or [""]))
        parts.append(known.where(hit).select(F.lit(d["authority_domain"]).alias("authority_domain"), "target", "writer", F.when(ok, "canonical_write").otherwise("illegal_write").alias("kind"), "role", "line", "operation", "provenance"))
    seeded = reduce(DataFrame.unionByName, parts) if parts else None
    free = known if seeded is None else known.join(seeded.select("target").distinct(), "target", "left_anti")
    shared = structure.shared_targets(free.select("target", "writer", F.element_at(F.split("writer", "/"), 1).alias("root"))).join(free.where("role = 'production'").select("target").distinct(), "target", "left_semi")
    auto = free.join(shared.select("target"), "target").select(F.concat(F.lit("shared_write:"), "target").alias("authority_domain"), "target", "writer", F.lit("shared_write").alias("kind"), "role", "line", "operation", "provenance")
    out = auto if seeded is None else seeded.unionByName(auto)
    if seed is None:
        out = out.unionByName(best.select(F.concat(F.lit("writer:"), "writer").alias("authority_domain"), "target", "writer", F.lit("inferred_write").alias("kind"), "role", "line", "operation", "provenance"))
    return out


def conflicts(spark: SparkSession, s: DataFrame, r: DataFrame, c: DataFrame, a: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(conflict_id, domain, subject, severity, files, conflict_status) by seven rules, the first of equal ids kept."""
    none = F.array().cast("array<string>")
    illegal = a.where("kind = 'illegal_write'")
    prod = F.col("role") == "production"
    shared = a.where("kind = 'shared_write'").groupBy("authority_domain", "target").agg(F.array_sort(F.collect_set("writer")).alias("files"), F.max(prod).alias("prod"), F.count("*").alias("n")).where("n >= 2")
    owners = a.where("kind = 'canonical_write'").select("authority_domain", F.col("writer").alias("owner")).distinct()
    edges = s.select(F.col("file").alias("owner"), F.explode("imports_in").alias("writer"))
    cyc = s.where("component IS NOT NULL AND size(cycles) > 1").withColumn("production", paths.role(F.col("file")) == "production")
    scc = cyc.groupBy("component").agg(F.array_sort(F.collect_set("file")).alias("files"), F.max(F.size("imports_in")).alias("fan_in"), F.min("production").alias("all_p"), F.max("production").alias("any_p"), F.min("file").alias("subject")).where("size(files) >= 2 AND fan_in >= 3")
    imports = s.select(F.col("file").alias("path"), F.explode("imports_in").alias("importer"))
    variants = c.select("entity", "canonical_path", F.explode("variants.path").alias("importer")).where("importer <> canonical_path")
    loose = variants.join(imports.withColumnRenamed("path", "canonical_path"), ["canonical_path", "importer"], "left_anti")
    row = lambda df, domain, subject, severity, files: df.select(domain.alias("domain"), subject.alias("subject"), severity.alias("severity"), files.alias("files"))
    rules = [
        row(illegal, F.col("authority_domain"), F.concat_ws("::", "authority_domain", "writer"), F.lit("high"), F.array("writer")),
        row(illegal.join(owners, "authority_domain").join(edges, ["owner", "writer"]), F.concat("authority_domain", F.lit(":structural")), F.concat_ws("::", "authority_domain", "writer"), F.lit("medium"), F.array("owner", "writer")),
        row(shared, F.lit("shared_write"), F.concat_ws("::", "authority_domain", "target"), F.when(F.col("prod"), "medium").otherwise("low"), F.col("files")),
        row(loose, F.lit("contract_structural"), F.concat_ws("::", "entity", "importer"), F.lit("medium"), F.array("importer", "canonical_path")),
        row(scc, F.lit("structural_cycle"), F.col("subject"), F.when(F.col("all_p"), "high").when(F.col("any_p"), "medium").otherwise("low"), F.col("files")),
        row(c.where("size(drift_flags) > 0"), F.lit("contract_drift"), F.col("entity"), F.lit("medium"), F.transform("variants", lambda v: v["path"])),
        row(r.where((F.size(F.coalesce("depends_on_env", none)) > 0) & (paths.role(F.col("defined_in")) == "production")), F.lit("env_coupling"), F.col("node"), F.lit("low"), F.array("defined_in")),
    ]
    all_ = reduce(DataFrame.union, [x.withColumn("rule", F.lit(i)) for i, x in enumerate(rules)])
    keyed = all_.withColumn("conflict_id", F.concat(F.lit("conf_"), paths.short_hash(12, F.col("domain"), F.col("subject"), F.array_join(F.array_sort("files"), ","))))
    once = keyed.withColumn("k", F.row_number().over(W.partitionBy("conflict_id").orderBy("rule"))).where("k = 1").drop("k", "rule")
    if previous is None:
        return once.withColumn("conflict_status", F.lit("open"))
    old = previous.select("conflict_id", *[F.col(x).alias(f"old_{x}") for x in ("domain", "subject", "severity", "files", "conflict_status")])
    j = once.join(old, "conflict_id", "full_outer")
    status = F.when(F.col("domain").isNull(), "resolved").when(F.col("old_conflict_status").isin("resolved", "validated"), F.col("old_conflict_status")).otherwise("open")
    return j.select("conflict_id", *[F.coalesce(x, f"old_{x}").alias(x) for x in ("domain", "subject", "severity", "files")], status.alias("conflict_status"))


def guard_conflicts(c: DataFrame) -> DataFrame:
    if c.where("conflict_status = 'open'").count() > MOST_CONFLICTS:
        raise RuntimeError(f"over {MOST_CONFLICTS} open conflicts")
    return c


def hotspots(s: DataFrame, r: DataFrame, c: DataFrame, a: DataFrame, conf: DataFrame, churn: DataFrame | None = None, sanctioned: list[str] | None = None) -> DataFrame:
    """(target, hotspot_score, reasons, recommended_mode) of every file."""
    weight = F.create_map(*[F.lit(x) for k, v in {"large_file": 10, "fan_in": 8, "fan_out": 3, "cycle_member": 5}.items() for x in (k, v)])
    j = s.select(F.col("file").alias("target"), F.least(F.lit(20), F.aggregate("tags", F.lit(0), lambda x, t: x + F.coalesce(F.try_element_at(weight, t), F.lit(0)))).alias("structural"))
    effect = F.when(F.size("side_effects") > 0, 8).otherwise(0) + F.when(F.array_contains("tags", "background_task"), 5).otherwise(0) + F.when(F.array_contains("tags", "decorator_registry"), 3).otherwise(0)
    open_ = conf.where("conflict_status = 'open'").select(F.explode("files").alias("target")).distinct()
    is_open = conf.where("conflict_status = 'open'")
    fought = is_open.select(F.col("domain").alias("owned")).union(is_open.select(F.regexp_extract("subject", "^(.*?)::", 1))).where("owned <> ''").distinct()
    parts = {
        "runtime": r.groupBy(F.col("defined_in").alias("target")).agg(F.least(F.lit(20), F.sum(effect)).alias("runtime")),
        # The first domain that a file owns: 20 points if that domain has an open conflict, else 5.
        "ownership": a.where("kind IN ('canonical_write', 'shared_write')").groupBy(F.col("writer").alias("target")).agg(F.min("authority_domain").alias("owned")).join(fought.withColumn("o", F.lit(True)), "owned", "left").select("target", F.when(F.col("o"), 20).otherwise(5).alias("ownership")),
        "conflict": open_.withColumn("conflict", F.lit(10)),
        "duplication": c.where("size(drift_flags) > 0").select(F.explode(F.array_union("writers", "readers")).alias("target")).distinct().withColumn("duplication", F.lit(10)),
    }
    if churn is not None:
        parts["churn"] = churn.groupBy(F.col("path").alias("target")).agg(structure.churn_points(F.sum(F.col("added") + F.col("deleted"))).alias("churn"))
    for t in parts.values():
        j = j.join(t, "target", "left")
    # Some file named test_* contains test_<stem>: the stem begins what follows one of the file's "test_".
    t = s.select(paths.basename(F.col("file")).alias("t")).where("t LIKE 'test\\_%'").distinct()
    rest = t.select(F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.when(F.substring("t", i, F.lit(5)) == "test_", F.substring("t", i + 5, F.length("t")))), lambda x: x.isNotNull())).alias("r")).where("r <> ''")
    tests = rest.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("r")), lambda i: F.substring("r", F.lit(1), i))).alias("stem")).distinct()
    j = j.withColumn("stem", paths.stem(F.col("target"))).join(tests.withColumn("has_test", F.lit(True)), "stem", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)) if x in parts else F.lit(0)
    gap = F.when(F.col("has_test"), 0).otherwise(10)
    score = F.col("structural") + zero("runtime") + F.least(F.lit(20), zero("ownership") + zero("conflict")) + zero("duplication") + gap + zero("churn") - 5 - F.when(paths.is_test(F.col("target")), 10).otherwise(0)
    reasons = F.array_compact(F.array(*[F.when(x > 0, F.lit(n)) for n, x in [("structural", F.col("structural")), *[(k, zero(k)) for k in parts], ("test_gap", gap)]]))
    made = j.select("target", F.greatest(F.lit(0), F.least(F.lit(130), score)).cast("int").alias("hotspot_score"), reasons.alias("reasons"))
    for g in sanctioned or []:
        made = made.where(~F.col("target").rlike(paths.glob_regex(g)))
    return made.withColumn("recommended_mode", structure.mode_for(F.col("hotspot_score")))


def boundaries(conf: DataFrame, hot: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(boundary_id, allowed_files, watch_files, forbidden_files) for each cycle conflict; seeds first, equal file sets dropped."""
    m = conf.where("domain = 'structural_cycle' AND conflict_status = 'open'").select("conflict_id", "subject", F.explode("files").alias("target")).join(hot.select("target", "hotspot_score"), "target", "left").fillna({"hotspot_score": 0})
    pick = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("target"))))
    by = m.groupBy("conflict_id", "subject").agg(
        pick(F.col("hotspot_score") < 30).alias("safe"), pick(F.col("hotspot_score").between(30, 59)).alias("watch_files"), pick(F.col("hotspot_score") >= 60).alias("forbidden_files"), F.array_sort(F.collect_set("target")).alias("members")
    )
    made = by.select(F.concat(F.lit("auto_"), F.substring(F.sha2(F.array_join("members", ","), 256), 1, 8)).alias("boundary_id"), F.concat("safe", "watch_files").alias("allowed_files"), "watch_files", "forbidden_files", "members")
    # Of clusters that share a file the one of the least id stays.
    member = made.select("boundary_id", F.explode("members").alias("m"))
    least = member.groupBy("m").agg(F.min("boundary_id").alias("least"))
    lost = member.join(least, "m").where("boundary_id <> least").select("boundary_id").distinct()
    made = made.dropDuplicates(["boundary_id"]).join(lost, "boundary_id", "left_anti")
    if seeds is None:
        return made
    own = seeds.select("boundary_id", "allowed_files", "watch_files", "forbidden_files", F.array_sort(F.array_distinct(F.concat("allowed_files", "forbidden_files"))).alias("members"))
    return own.unionByName(made.join(own.select("members"), "members", "left_anti"))


def findings(s: DataFrame, r: DataFrame, c: DataFrame, a: DataFrame, conf: DataFrame, hot: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(finding_id, category, subject, severity, finding_status) by five rules."""
    open_ = conf.where("conflict_status = 'open'")
    fan = s.select(F.col("file").alias("target"), F.size("imports_in").alias("fan_in"))
    cyc = open_.where("domain = 'structural_cycle'").select("subject", "severity", F.explode("files").alias("target")).join(hot, "target", "left").join(fan, "target", "left")
    cycles = cyc.groupBy("subject", "severity").agg(F.max("hotspot_score").alias("hot"), F.max("fan_in").alias("fan")).where("hot >= 60 AND fan >= 5")
    owners = a.where("kind = 'shared_write' AND role = 'production'").groupBy("target").agg(F.countDistinct("writer").alias("n")).where("n >= 2").join(r.select(F.col("defined_in").alias("target")).distinct(), "target", "left_semi")
    drift = c.where("size(drift_flags) > 0 AND size(readers) >= 2")
    env = r.select(F.explode("depends_on_env").alias("env")).distinct().join(c.select(F.col("entity").alias("env")), "env", "left_anti")
    illegal = a.where("kind = 'illegal_write' AND provenance = 'path_constructor'")
    row = lambda df, cat, subject, sev: df.select(F.lit(cat).alias("category"), subject.alias("subject"), sev.alias("severity"))
    made = reduce(
        DataFrame.union,
        [
            row(cycles, "architecture_cycle", F.col("subject"), F.when(F.col("severity") == "high", "CRITICAL").otherwise("HIGH")),
            row(owners, "state_ownership_conflict", F.col("target"), F.lit("HIGH")),
            row(drift, "schema_drift_risk", F.col("entity"), F.lit("MEDIUM")),
            row(env, "runtime_config_risk", F.col("env"), F.when(F.upper("env").rlike("KEY|SECRET|TOKEN|PASS"), "MEDIUM").otherwise("LOW")),
            row(illegal, "write_authority_violation", F.concat_ws("::", "authority_domain", "writer"), F.lit("HIGH")),
        ],
    ).distinct()
    named = made.withColumn("finding_id", F.concat("category", F.lit("_"), paths.short_hash(16, F.col("category"), F.col("subject"))))
    if previous is None:
        return named.withColumn("finding_status", F.lit("new"))
    life = report.lifecycle(named, previous)
    text = named.select("finding_id", "category", "subject").unionByName(previous.select("finding_id", "category", "subject")).dropDuplicates(["finding_id"])
    return life.join(text, "finding_id")


def conflict_evidence(conflicts_: DataFrame, authority_: DataFrame, most: int = 10) -> DataFrame:
    """(conflict_id, evidence): the first five files, the targets of the conflict's domain if it is one of writes, up to three
    members of a cycle; ten at most, in that order."""
    base = F.transform(F.slice("files", 1, 5), lambda f: F.concat(F.lit("file:"), f))
    cycle = F.when(F.col("domain") == "structural_cycle", F.transform(F.slice("files", 1, 3), lambda f: F.concat(F.lit("cycle:"), f))).otherwise(F.array().cast("array<string>"))
    target = authority_.where("target <> ''").groupBy(F.col("authority_domain").alias("d")).agg(F.min("target").alias("target_path"))
    j = conflicts_.withColumn("d", F.regexp_extract("subject", "^(.*?)::", 1)).join(target, "d", "left")
    write = F.when(F.col("domain").contains("write") & F.col("target_path").isNotNull(), F.array(F.concat(F.lit("target:"), F.col("target_path")))).otherwise(F.array().cast("array<string>"))
    return j.select("conflict_id", F.slice(F.array_distinct(F.concat(base, write, cycle)), 1, most).alias("evidence"))


def hotspot_evidence(hot: DataFrame, conf: DataFrame, most: int = 10) -> DataFrame:
    """(target, evidence): the reasons of a file's score, and the open conflicts that name it."""
    named = conf.where("conflict_status = 'open'").select(F.explode("files").alias("target"), F.concat(F.lit("conflict:"), "conflict_id").alias("c")).groupBy("target").agg(F.slice(F.array_sort(F.collect_set("c")), 1, most).alias("cs"))
    return hot.join(named, "target", "left").select("target", F.slice(F.concat(F.transform("reasons", lambda x: F.concat(F.lit("reason:"), x)), F.coalesce("cs", F.array().cast("array<string>"))), 1, most).alias("evidence"))
