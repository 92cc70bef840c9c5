"""Findings to reports: identity, suppression, allowlist, floor, counts, top lists, caps, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import paths

# Order of severities.
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]


def rank(severity: Column) -> Column:
    """0 for INFO and unknown ones, up to 4."""
    return F.greatest(F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.upper(severity)), F.lit(1)) - 1, F.lit(0))


def identified(findings: DataFrame) -> DataFrame:
    """findings with their fingerprint: 16 hex digits of check, path and detail."""
    return findings.withColumn("fingerprint", paths.short_hash(16, F.col("check_id"), F.col("path"), F.coalesce("detail", F.lit(""))))


def floor(findings: DataFrame, least: str = "LOW") -> DataFrame:
    """INFO ranks with LOW at the floor LOW, as only higher floors remove anything below them."""
    low = SEVERITIES.index(least.upper())
    return findings if low <= 1 else findings.where(rank(F.col("severity")) >= low)


def suppressed(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """findings without those that a marker (noqa: id, autoforensics-skip: id) names on their line or the line above, or, where
    they have no line (null or 0), in the first 20 lines; a parent id covers its children."""
    marks = lines.where(F.lower("line").rlike("noqa:|autoforensics-skip:")).select("path", F.col("line_no").alias("at"), F.explode(F.regexp_extract_all("line", F.lit(r"(?i)(?:noqa|autoforensics-skip):\s*([A-Za-z0-9_.]+)"), F.lit(1))).alias("id"))
    f = findings.alias("f")
    near = F.when(F.coalesce("f.line_no", F.lit(0)) < 1, F.col("at") <= 20).otherwise(F.col("f.line_no").between(F.col("at"), F.col("at") + 1))
    hit = (F.col("f.path") == marks["path"]) & near & ((F.col("f.check_id") == F.col("id")) | F.col("f.check_id").startswith(F.concat("id", F.lit("."))))
    return f.join(marks, hit, "left_anti")


# Kinds of evidence, and days that an entry without an end holds.
EVIDENCE, TTL_DAYS = ["test", "grep", "spec", "doc", "code", "design_decision"], 90


def valid_entries(allowlist: DataFrame, files: DataFrame, now: str) -> DataFrame:
    """Entries with a reason and evidence of 10 characters, a known kind of evidence, not past their end (or, without one, their
    days from created_at), whose file is there with as many lines and with the words that `grep` names, if any."""
    has = lambda c: F.col(c) if c in allowlist.columns else F.lit(None).cast("string")
    ok = allowlist.where((F.length("reason") >= 10) & (F.length("evidence") >= 10) & F.col("evidence_type").isin(*EVIDENCE))
    made = F.try_to_timestamp(has("created_at"))
    ends = F.coalesce(F.try_to_timestamp(F.nullif("expires_at", F.lit(""))), F.expr(f"INTERVAL {TTL_DAYS} DAYS") + made)
    ok = ok.where(F.coalesce(ends > F.to_timestamp(F.lit(now)), F.lit(True)) if now else F.lit(True))
    there = ok.withColumn("grep_words", F.filter(F.split(F.coalesce(has("grep"), F.lit("")), r"\s+"), lambda w: w != "")).join(files.select(F.col("path").alias("file"), "line_count", *([F.col("text").alias("file_text")] if "text" in files.columns else [F.lit("").alias("file_text")])), "file")
    return there.where((F.col("line").isNull() | (F.col("line") <= F.col("line_count"))) & F.forall("grep_words", lambda w: F.coalesce(F.contains(F.col("file_text"), w), F.lit(False)))).drop("grep_words", "file_text")


def allowed(findings: DataFrame, allowlist: DataFrame, files: DataFrame, now: str) -> DataFrame:
    """findings without those that a valid entry names."""
    if "line_count" not in files.columns:
        files = files.withColumn("line_count", F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n")))
    return findings.join(valid_entries(allowlist, files, now).select("fingerprint"), "fingerprint", "left_anti")


def entry(findings: DataFrame, reason: str, evidence: str, evidence_type: str, now: str, expires_at: str = "") -> DataFrame:
    """Allowlist entries for findings."""
    return findings.select("fingerprint", F.col("path").alias("file"), F.col("line_no").alias("line"), "check_id", F.lit(reason).alias("reason"), F.lit(evidence).alias("evidence"), F.lit(evidence_type).alias("evidence_type"), F.lit(now).alias("created_at"), F.lit(expires_at).alias("expires_at"))


def upsert(allowlist: DataFrame, entries: DataFrame) -> DataFrame:
    """The allowlist with entries in place of those of their fingerprint; entries without a reason or evidence are an error."""
    if not entries.where((F.length("reason") < 10) | (F.length("evidence") < 10) | ~F.col("evidence_type").isin(*EVIDENCE)).isEmpty():
        raise ValueError("an entry needs a reason and evidence of 10 characters, of a known kind")
    kept = allowlist.join(entries.select("fingerprint"), "fingerprint", "left_anti")
    return kept.unionByName(entries, allowMissingColumns=True)


def counts(findings: DataFrame) -> DataFrame:
    """(severity, category, n): the report's counts; the category is the check's first part."""
    return findings.groupBy("severity", F.element_at(F.split("check_id", r"\."), 1).alias("category")).agg(F.count("*").alias("n"))


def audit_summary(findings: DataFrame) -> DataFrame:
    """One row: total, high (with critical), medium, low (with info)."""
    n = lambda *xs: F.sum(F.col("severity").isin(*xs).cast("long"))
    return findings.agg(F.count("*").alias("total"), F.coalesce(n("HIGH", "CRITICAL"), F.lit(0)).alias("high"), F.coalesce(n("MEDIUM"), F.lit(0)).alias("medium"), F.coalesce(n("LOW", "INFO"), F.lit(0)).alias("low"))


def first_of_worst(findings: DataFrame, n: int = 20) -> DataFrame:
    """The first findings of the highest severity there is."""
    worst = findings.agg(F.max(rank(F.col("severity"))).alias("worst"))
    return findings.join(F.broadcast(worst), rank(F.col("severity")) == F.col("worst")).drop("worst").orderBy("check_id", "path", "line_no").limit(n)


def filtered(findings: DataFrame, severity: str | None = None, check_id: str | None = None, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """Findings of a severity and a check, `most` at most in order, and one row (total, truncated)."""
    f = findings
    if severity:
        f = f.where(F.col("severity") == severity.upper())
    if check_id:
        f = f.where(F.col("check_id") == check_id)
    return top(f, most), f.agg(F.count("*").alias("total")).withColumn("truncated", F.col("total") > most)


def page(text: DataFrame, number: int, size: int = 20_000) -> DataFrame:
    """Characters of page `number` (from 0) of each (name, text), with total and total_pages."""
    pages = F.ceil(F.length("text") / size).cast("int")
    return text.select("name", F.substring("text", number * size + 1, size).alias("text"), F.length("text").alias("total"), pages.alias("total_pages"), (F.lit(number + 1) < pages).alias("truncated"))


def map_summary(maps: dict[str, DataFrame], n: int = 10) -> DataFrame:
    """(map, total, first): rows of each map, and its first keys."""
    out = None
    for name, df in maps.items():
        key = F.col(next(c for c in ("name", "node", "file", "target", "entity", "finding_id", "conflict_id", "boundary_id", "authority_domain", df.columns[0]) if c in df.columns)).cast("string")
        total = df.agg(F.count("*").alias("total"))
        first = df.select(key.alias("k")).distinct().orderBy("k").limit(n).agg(F.array_sort(F.collect_list("k")).alias("first"))
        row = total.crossJoin(first).select(F.lit(name).alias("map"), "total", "first")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def agent_brief(runtime: DataFrame, authority: DataFrame, hotspots: DataFrame, conflicts: DataFrame, n: int = 6) -> DataFrame:
    """(part, place, key): the first entry points, domains, hotspots by score and open conflicts by severity, and the files to
    read in this order: entry points, then hotspots, each once."""
    entry_ = runtime.where(F.col("kind").isin("main_entrypoint", "entry_function")).select("node", "defined_in").orderBy("node").limit(n)
    hot = hotspots.orderBy(F.desc("hotspot_score"), "target").limit(n)
    parts = [
        ("runtime", entry_.select(F.col("node").alias("key"), F.col("node").alias("o"))),
        ("authority", authority.select(F.col("authority_domain").alias("key")).distinct().orderBy("key").limit(n).select("key", F.col("key").alias("o"))),
        ("hotspot", hot.select(F.col("target").alias("key"), F.concat(F.lpad((1000 - F.col("hotspot_score")).cast("string"), 4, "0"), "target").alias("o"))),
        ("conflict", conflicts.where("conflict_status = 'open'").orderBy(F.desc(rank(F.upper("severity"))), "conflict_id").limit(n).select(F.col("conflict_id").alias("key"), F.concat((9 - rank(F.upper("severity"))).cast("string"), "conflict_id").alias("o"))),
        ("read", entry_.select(F.col("defined_in").alias("key"), F.concat(F.lit("0"), "node").alias("o")).union(hot.select("target", F.concat(F.lit("1"), F.lpad((1000 - F.col("hotspot_score")).cast("string"), 4, "0"), "target"))).groupBy("key").agg(F.min("o").alias("o"))),
    ]
    out = None
    for name, df in parts:  # a few rows each
        row = df.withColumn("place", F.row_number().over(W.orderBy("o"))).select(F.lit(name).alias("part"), "place", "key")
        out = row if out is None else out.unionByName(row)
    return out


# What a key or value that must not be shown looks like.
SECRET_KEY, SECRET_VALUE = "(?i)password|passwd|secret|token|api_?key|credential|authorization|private_?key", "(?i)^(sk-|ghp_|xox[bap]-|AKIA|eyJ)"


def redacted(rows: DataFrame, key: str, value: str, most: int = 200) -> DataFrame:
    """rows with the value masked where its key or its own form is that of a secret, else cut to a preview."""
    shown = F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("..."))).otherwise(F.col(value))
    return rows.withColumn(value, F.when(F.col(key).rlike(SECRET_KEY) | F.col(value).rlike(SECRET_VALUE), "***").otherwise(shown))


def same_map(new: DataFrame, old: DataFrame, volatile: list[str] = ["generated_at", "updated_at", "last_seen", "first_seen", "run_id", "duration", "freshness", "build_id", "commit", "timestamp"]) -> bool:  # noqa: B006
    """Whether two maps are equal but for fields that change with every run."""
    keep = [c for c in new.columns if c not in volatile]
    if sorted(keep) != sorted(c for c in old.columns if c not in volatile):
        return False
    plain = lambda df: df.select(*[F.to_json(F.struct(*[F.col(c) for c in sorted(keep)])).alias("row")])
    a, b = plain(new), plain(old)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity and category (check prefix), with subtotals (nulls)."""
    return findings.rollup("severity", "check_id").agg(F.count("*").alias("n"))


def top_checks(findings: DataFrame, n: int = 25) -> DataFrame:
    return findings.groupBy("check_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "check_id").limit(n)


def top(findings: DataFrame, n: int = 20) -> DataFrame:
    """The first findings by severity, check, path and line."""
    return findings.orderBy(F.desc(rank(F.col("severity"))), "check_id", "path", "line_no").limit(n)


def capped(findings: DataFrame, per_file: int = 10, order: str = "line_no") -> DataFrame:
    """At most `per_file` findings of a check in a file."""
    n = F.row_number().over(W.partitionBy("check_id", "path").orderBy(order))
    return findings.withColumn("nth", n).where(F.col("nth") <= per_file).drop("nth")


def lifecycle(now: DataFrame, before: DataFrame, key: str = "finding_id") -> DataFrame:
    """(key, severity, finding_status): new, existing, worsened (severity rose) or resolved (gone)."""
    a = now.select(key, F.col("severity").alias("new"))
    b = before.select(key, F.col("severity").alias("old"))
    status = F.when(F.col("new").isNull(), "resolved").when(F.col("old").isNull(), "new").when(rank(F.col("new")) > rank(F.col("old")), "worsened").otherwise("existing")
    return a.join(b, key, "full_outer").select(key, F.coalesce("new", "old").alias("severity"), status.alias("finding_status"))
