"""Checks of the records of a run: what was claimed, changed, verified and left behind. Each takes small tables and gives findings
(check_id, path, line_no, detail, severity, impact); nothing of them is found in source alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths

FIX_WORDS = r"(?i)\b(fix|fixes|fixed|bug|bugfix|hotfix|regression|repair)\b"
#: Words of an intent that say nothing, and paths that may be dirty.
STOP_WORDS = "the a an and or of to in on for with from this that is are be it as by at".split()


def _row(rows: DataFrame, check: str | Column, path: Column, detail: Column, severity: str, impact: str = "REVISE") -> DataFrame:
    check = F.lit(check) if isinstance(check, str) else check
    return rows.select(check.alias("check_id"), path.alias("path"), F.lit(1).alias("line_no"), detail.alias("detail"), F.lit(severity).alias("severity"), F.lit(impact).alias("impact"))


def edit_consistency(instances: DataFrame, pattern: str) -> DataFrame:
    """edit_consistency: instances (path, text) that don't match the pattern expected of all."""
    return _row(instances.where(~F.coalesce(F.col("text").rlike(pattern), F.lit(False))), "edit_consistency", F.col("path"), F.col("text"), "MEDIUM")


def mutation_verified(expected: DataFrame, files: DataFrame) -> DataFrame:
    """mutation_verified: files (path, hash) whose content now has another SHA-256, or that are gone."""
    now = files.select("path", F.sha2("text", 256).alias("now"))
    bad = expected.join(now, "path", "left").where(F.col("now").isNull() | (F.col("now") != F.col("hash")))
    return _row(bad, "mutation_verified", F.col("path"), F.when(F.col("now").isNull(), "gone").otherwise("other content"), "HIGH")


def success_proof(statuses: DataFrame, proofs: list[str]) -> DataFrame:
    """success_proof: statuses (run, ok, phase, fields map) that claim success and lack a proof's field."""
    lacking = F.filter(F.array(*[F.lit(p) for p in proofs]), lambda p: F.coalesce(F.col("fields")[p], F.lit("")) == "")
    claimed = statuses.where(F.coalesce("ok", F.lit(False)) | (F.col("phase") == "completed")).withColumn("lack", lacking)
    return _row(claimed.where(F.size("lack") > 0), "success_proof", F.col("run"), F.array_join("lack", ","), "HIGH", "BLOCK")


def sources_named(labels: DataFrame) -> DataFrame:
    """source_truthfulness: labels (label, stated, actual) whose stated source isn't the actual one."""
    return _row(labels.where(~F.col("stated").eqNullSafe(F.col("actual"))), "source_truthfulness", F.col("label"), F.concat_ws(" for ", "stated", "actual"), "HIGH")


def config_applied(settings: DataFrame) -> DataFrame:
    """config_applied: settings (key, persisted, consumed) that were set but not kept, or that nothing reads."""
    bad = settings.where(~F.col("persisted") | ~F.col("consumed"))
    return _row(bad, "config_applied", F.col("key"), F.when(~F.col("persisted"), "not persisted").otherwise("not consumed"), "HIGH")


def state_consistency(states: DataFrame, keys: list[str]) -> DataFrame:
    """state_consistency: keys whose values differ between representations (name, values map)."""
    rows = states.select("name", F.explode(F.array(*[F.lit(k) for k in keys])).alias("key")).join(states, "name").select("key", F.col("values")[F.col("key")].alias("value"))
    differ = rows.groupBy("key").agg(F.countDistinct(F.coalesce("value", F.lit("\u0000"))).alias("n"), F.min("value").alias("a"), F.max("value").alias("b")).where("n > 1")
    return _row(differ, "state_consistency", F.col("key"), F.concat_ws(" / ", "a", "b"), "HIGH")


def fallback_transparency(uses: DataFrame) -> DataFrame:
    """fallback_transparency: uses (name, primary_available, fallback_used, labeled) of a fallback that says nothing."""
    return _row(uses.where("fallback_used AND NOT labeled"), "fallback_transparency", F.col("name"), F.when(F.col("primary_available"), "primary was there").otherwise("unlabelled"), "HIGH")


def roundtrip(pairs: DataFrame) -> DataFrame:
    """roundtrip_check: keys of (name, original map, back map) that are lost, new or changed."""
    keys = F.array_sort(F.filter(F.array_union(F.map_keys("original"), F.map_keys("back")), lambda k: ~F.col("original")[k].eqNullSafe(F.col("back")[k])))
    return _row(pairs.withColumn("key", F.explode(keys)), "roundtrip_check", F.col("name"), F.col("key"), "MEDIUM")


def fix_without_test(intents: DataFrame, changed: DataFrame) -> DataFrame:
    """fix_without_test: runs (run, intent) that speak of a fix and changed (run, path) source but no test."""
    test = paths.is_test(F.col("path"))
    by = changed.groupBy("run").agg(F.sum(test.cast("int")).alias("tests"), F.sum((~test & paths.language(F.col("path")).isNotNull()).cast("int")).alias("sources"))
    return _row(intents.where(F.col("intent").rlike(FIX_WORDS)).join(by, "run").where("sources > 0 AND tests = 0"), "fix_without_test.no_tests", F.col("run"), F.col("intent"), "MEDIUM")


def semantic_intent(intents: DataFrame, changed: DataFrame, forbidden: list[str], reports: DataFrame) -> DataFrame:
    """semantic: no word of an intent of three words or more stands in a changed path or its text's start; an edit under a
    forbidden path; success reported (run, ok, blockers) with blockers."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))
    said = intents.select("run", "intent", words(F.col("intent")).alias("w")).where("size(w) >= 3")
    seen = changed.select("run", F.explode(words(F.col("path"))).alias("x")).distinct()
    met = said.select("run", F.explode("w").alias("x")).join(seen, ["run", "x"]).select("run").distinct()
    off = said.join(changed.select("run").distinct(), "run").join(met, "run", "left_anti")
    bad = F.lit(False)
    for f in forbidden:
        bad = bad | F.col("path").startswith(f)
    return (
        _row(off, "semantic.no_keyword_overlap", F.col("run"), F.col("intent"), "MEDIUM")
        .unionByName(_row(changed.where(bad), "semantic.forbidden_edit", F.col("path"), F.col("run"), "HIGH", "BLOCK"))
        .unionByName(_row(reports.where((F.col("ok")) & (F.size("blockers") > 0)), "semantic.success_with_blockers", F.col("run"), F.array_join("blockers", ","), "HIGH", "BLOCK"))
    )


def temporal(artifacts: DataFrame, order: list[str]) -> DataFrame:
    """temporal: artifacts (run, kind, at) older than one of a kind that comes before theirs."""
    place = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    a = artifacts.withColumn("place", place).where("place > 0")
    latest = a.select("run", F.col("place").alias("p"), F.col("at").alias("before"))
    steps = a.join(latest, "run").where("p < place").groupBy("run", "kind", "at").agg(F.max("before").alias("before")).where("at < before")
    return _row(steps, "temporal.stale_artifact", F.col("run"), F.col("kind"), "MEDIUM")


def testing(changed: DataFrame, verified: DataFrame, critical: list[str]) -> DataFrame:
    """testing: critical files changed (run, path) in runs without a verification (run, passed), or with a failed one."""
    hit = F.lit(False)
    for c in critical:
        hit = hit | F.col("path").startswith(c)
    touched = changed.where(hit).groupBy("run").agg(F.min("path").alias("path"))
    j = touched.join(verified.groupBy("run").agg(F.min("passed").alias("passed")), "run", "left")
    return _row(j.where("passed IS NULL"), "testing.critical_unverified", F.col("path"), F.col("run"), "HIGH").unionByName(_row(j.where("NOT passed"), "testing.verification_failed", F.col("path"), F.col("run"), "CRITICAL", "BLOCK"))


def reporting(reports: DataFrame, artifacts: DataFrame) -> DataFrame:
    """reporting: artifacts that a report (run, accepted, refs, blocking) names and that aren't there; acceptance beside blocking issues."""
    named = reports.select("run", F.explode("refs").alias("path"))
    gone = named.join(artifacts.select("path").distinct(), "path", "left_anti")
    return _row(gone, "reporting.artifact_missing", F.col("path"), F.col("run"), "HIGH").unionByName(_row(reports.where("accepted AND blocking > 0"), "reporting.acceptance_with_blockers", F.col("run"), F.col("blocking").cast("string"), "HIGH", "BLOCK"))


def runtime_claims(health: DataFrame) -> DataFrame:
    """runtime: health (run, claimed, verified, identity, expected_identity) that says other than its verification, or is another's."""
    return _row(health.where("claimed <> verified"), "runtime.claim_contradiction", F.col("run"), F.concat_ws(" / ", "claimed", "verified"), "HIGH").unionByName(
        _row(health.where("identity <> expected_identity"), "runtime.identity_mismatch", F.col("run"), F.concat_ws(" / ", "identity", "expected_identity"), "HIGH")
    )


def context_health(contexts: DataFrame) -> DataFrame:
    """context_health: contexts (run, n_files, n_unreadable, n_maps, has_profile) with nothing to check, unreadable files, no maps, no profile."""
    what = F.array_compact(F.array(F.when(F.col("n_files") == 0, "no_files"), F.when(F.col("n_unreadable") > 0, "unreadable_files"), F.when(F.col("n_maps") == 0, "no_maps"), F.when(~F.col("has_profile"), "no_profile")))
    return _row(contexts.withColumn("what", F.explode(what)), F.concat(F.lit("context_health."), "what"), F.col("run"), F.col("what"), "MEDIUM")


def dirty_baseline(status: DataFrame, allowed: list[str], most: int = 5) -> DataFrame:
    """dirty_baseline: more than `most` paths of `git status --porcelain` (value) outside the allowed prefixes."""
    p = status.select(F.substring("value", 4, 2**20).alias("path")).where("path <> ''")
    for a in allowed:
        p = p.where(~F.col("path").startswith(a))
    n = p.agg(F.count("*").alias("n"), F.min("path").alias("path")).where(F.col("n") > most)
    return _row(n, "dirty_baseline", F.col("path"), F.col("n").cast("string"), "HIGH", "BLOCK")


def provider_capabilities(providers: DataFrame, needed: list[str]) -> DataFrame:
    """PC01 and PC02: providers (name, capabilities) that declare nothing, or not all that is needed."""
    lack = F.array_except(F.array(*[F.lit(x) for x in needed]), F.col("capabilities"))
    return _row(providers.where(F.coalesce(F.size("capabilities"), F.lit(0)) <= 0), "PC01", F.col("name"), F.lit("none declared"), "MEDIUM").unionByName(
        _row(providers.withColumn("lack", lack).where("size(capabilities) > 0 AND size(lack) > 0"), "PC02", F.col("name"), F.array_join("lack", ","), "HIGH")
    )


def artifact_completeness(artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """hunter_artifact_completeness: cached JSON (path, text) that doesn't parse or lacks a key."""
    v = F.expr("try_parse_json(text)")
    bad = artifacts.where(v.isNull())
    lack = F.array_except(F.array(*[F.lit(k) for k in keys]), F.coalesce(F.expr("json_object_keys(text)"), F.array().cast("array<string>")))
    partial = artifacts.where(v.isNotNull()).withColumn("lack", lack).where("size(lack) > 0")
    return _row(bad, "hunter_artifact_completeness", F.col("path"), F.lit("not JSON"), "HIGH").unionByName(_row(partial, "hunter_artifact_completeness", F.col("path"), F.array_join("lack", ","), "MEDIUM"))
