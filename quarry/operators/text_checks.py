"""Checks of lines in their surroundings: the lines before and after, the file as a whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import paths

# Fixed values of the checks: numbers that are never magic, words and phrases of log messages.
SAFE_NUMBERS = [0, 1, 2, 3, 4, 5, -1, -2, 10, 100, 1000, 200, 201, 204, 301, 302, 400, 401, 403, 404, 409, 500, 501, 503, 60, 120, 300, 3600, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]
ERROR_WORDS = "error|fail|crash|fatal|critical|exception|broken|corrupt"
NORMAL_WORDS = "start|ready|success|loaded|initialized|connected|listening"
EXPECTED = "failed to|could not|unable to|cannot |timeout|timed out|not found|not available|skipping|falling back|does not exist|missing|unavailable|unreachable|ignored|discarded|dropped|closed|no longer|already |stale"
LOG = r"""(?i)\b(?:log(?:ger)?|_log|logging)\.(debug|info|warning|error|critical)\s*\(\s*[f"'](.{5,80})"""
RESPONSE = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:await\s+)?(?:requests|httpx|session|client)\.(?:get|post|put|patch|delete)\s*\("
CODE_LINE = r"^\s*(?:#|//)\s*(?:(?:if|for|while|def|class|return|import|from|try|except|else|elif|with|const|let|var|function)\b.*[:;({]?|[A-Za-z_][\w.]*\s*(?:=|\().*)$"


def _found(rows: DataFrame, check: str, detail: Column, severity: str, impact: str = "REVISE") -> DataFrame:
    return rows.select(F.lit(check).alias("check_id"), "path", "line_no", detail.alias("detail"), F.lit(severity).alias("severity"), F.lit(impact).alias("impact"))


def _code(lines: DataFrame) -> DataFrame:
    return lines.where(~F.ltrim("line").startswith("#") & ~paths.is_test(F.col("path")))


def log_levels(lines: DataFrame) -> DataFrame:
    """log_level_scan: error words at debug or info, normal words at error or critical."""
    m = _code(lines).where(F.col("line").rlike(LOG)).withColumn("level", F.lower(F.regexp_extract("line", LOG, 1))).withColumn("msg", F.lower(F.regexp_extract("line", LOG, 2)))
    low = F.col("level").isin("debug", "info") & F.col("msg").rlike(ERROR_WORDS) & ~F.col("msg").rlike(EXPECTED)
    high = F.col("level").isin("error", "critical") & F.col("msg").rlike(NORMAL_WORDS) & ~F.col("msg").rlike(ERROR_WORDS)
    return _found(m.where(low | high), "log_level_scan", F.concat("level", F.lit("() with other severity")), "LOW", "WARN")


def naming(lines: DataFrame) -> DataFrame:
    """naming_scan: files of three definitions or more that mix snake_case and camelCase, or the minority's names."""
    d = _code(lines).select("path", "line_no", F.regexp_extract("line", r"^\s*(?:async\s+)?(?:def|function)\s+([A-Za-z_][A-Za-z0-9_]*)", 1).alias("name")).where("name <> ''")
    snake, camel = F.col("name").rlike("^_*[a-z0-9]+(_[a-z0-9]+)+_*$"), F.col("name").rlike("^_*[a-z]+[A-Z]")
    named = d.withColumn("style", F.when(snake, "snake").when(camel, "camel")).where("style IS NOT NULL")
    by = named.groupBy("path").agg(F.sum((F.col("style") == "snake").cast("int")).alias("s"), F.count("*").alias("n")).where("n >= 3").withColumn("ratio", F.col("s") / F.col("n"))
    j = named.join(by, "path")
    minority = j.where(((F.col("ratio") > 0.8) & (F.col("style") == "camel")) | ((F.col("ratio") < 0.2) & (F.col("style") == "snake")))
    mixed = by.where("ratio BETWEEN 0.3 AND 0.7").withColumn("line_no", F.lit(1))
    return _found(minority, "naming_scan", F.col("name"), "LOW", "WARN").unionByName(_found(mixed, "naming_scan", F.lit("mixed"), "LOW", "WARN"))


def unchecked_responses(lines: DataFrame, within: int = 10) -> DataFrame:
    """response_status_scan: a response whose status isn't looked at within ten lines."""
    r = _code(lines).withColumn("var", F.regexp_extract("line", RESPONSE, 1)).where("var <> ''").select("path", "line_no", "var")
    looks = lines.where(F.col("line").rlike(r"raise_for_status|status_code|\.ok\b|\.status\b|is_success")).select(F.col("path").alias("p"), F.col("line_no").alias("at"), F.col("line").alias("look"))
    hit = (F.col("path") == F.col("p")) & F.col("at").between(F.col("line_no"), F.col("line_no") + within) & F.col("look").contains(F.col("var"))
    return _found(r.join(looks, hit, "left_anti"), "response_status_scan", F.col("var"), "MEDIUM")


def commented_code(lines: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    """commented_code_scan: runs of three to ten comment lines, at least two of them like code, not in the first four lines."""
    c = lines.where(F.ltrim("line").rlike("^(#|//)") & (F.col("line_no") > 4))
    run = c.withColumn("g", F.col("line_no") - F.row_number().over(W.partitionBy("path").orderBy("line_no")))
    by = run.groupBy("path", "g").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"), F.sum(F.col("line").rlike(CODE_LINE).cast("int")).alias("like")).where(F.col("n").between(least, most) & (F.col("like") >= 2))
    return _found(by, "commented_code_scan", F.concat(F.col("n").cast("string"), F.lit(" lines")), "LOW", "WARN")


def magic_numbers(lines: DataFrame) -> DataFrame:
    """magic_number_scan: integers from 256 and floats from 1 in code, no constants, no round numbers."""
    text = F.regexp_replace(F.regexp_replace("line", "#.*$", ""), "\"[^\"]*\"|'[^']*'", "''")
    row = _code(lines).where(~F.col("line").rlike(r"^\s*[A-Z][A-Z0-9_]*\s*[:=]")).select("path", "line_no", F.explode(F.regexp_extract_all(text, F.lit(r"(?<![\w.\[])([0-9]+(?:\.[0-9]+)?)(?![\w.\]])"), F.lit(1))).alias("v"))
    v, real = F.col("v").cast("double"), F.col("v").contains(".")
    return _found(row.where(F.when(real, (v >= 1) & (v % 1 != 0)).otherwise((v >= 256) & ~v.isin(*[float(x) for x in SAFE_NUMBERS]))), "magic_number_scan", F.col("v"), "LOW", "WARN")


def log_without_context(lines: DataFrame) -> DataFrame:
    """log_context_scan: an error logged in a handler without the exception."""
    indent = F.length("line") - F.length(F.ltrim("line"))
    w = W.partitionBy("path").orderBy("line_no")
    head = F.when(F.col("line").rlike(r"^\s*except\b.*:"), F.struct(F.col("line_no").alias("at"), indent.alias("i"), F.regexp_extract("line", r"\bas\s+(\w+)", 1).alias("var")))
    j = lines.where(F.trim("line") != "").withColumn("h", F.last(head, ignorenulls=True).over(w)).where((F.col("line_no") > F.col("h.at")) & (indent > F.col("h.i")))
    left = F.min(F.when(indent <= F.col("h.i"), F.col("line_no"))).over(W.partitionBy("path", "h.at"))
    err = j.withColumn("left", left).where(F.col("line").rlike(r"\b(log|logger|logging|_log)\.error\s*\(") & ~F.col("line").contains("exc_info"))
    bare = F.regexp_replace("line", "\"[^\"]*\"|'[^']*'", "''")
    named = F.regexp_like(bare, F.concat(F.lit(r"[^A-Za-z0-9_]"), F.col("h.var"), F.lit(r"[^A-Za-z0-9_]")))
    return _found(err.where((F.col("h.var") == "") | ~named), "log_context_scan", F.trim("line"), "LOW", "WARN")


def resource_leaks(lines: DataFrame) -> DataFrame:
    """resource_leak_scan: opened and assigned without with; in Go without defer within five lines."""
    py = _code(lines).where(F.coalesce(paths.language(F.col("path")) == "python", F.lit(False)) & F.col("line").rlike(r"^\s*\w[\w.]*\s*=\s*(?:open|socket\.socket|sqlite3\.connect)\s*\("))
    go = lines.where((paths.extension(F.col("path")) == "go") & F.col("line").rlike(r":?=\s*os\.(Open|Create)\("))
    defers = lines.where(F.col("line").rlike(r"\bdefer\b.*\.Close\(")).select(F.col("path").alias("p"), F.col("line_no").alias("at"))
    bare = go.join(defers, (F.col("path") == F.col("p")) & F.col("at").between(F.col("line_no"), F.col("line_no") + 5), "left_anti")
    return _found(py.unionByName(bare), "resource_leak_scan", F.trim("line"), "MEDIUM")


def unpinned(lines: DataFrame) -> DataFrame:
    """unpinned_dep_scan: requirement lines without a version or with a loose one; package.json ranges."""
    req = lines.where(paths.basename(F.col("path")).rlike(r"^requirements.*\.txt$")).withColumn("s", F.trim("line")).where(~F.col("s").rlike("^(#|-|$)"))
    bare = req.where(F.col("s").rlike(r"^[A-Za-z][A-Za-z0-9._-]*\s*$"))
    loose = req.where(F.col("s").rlike(">=|<=|~=|!=") & ~F.col("s").contains("=="))
    npm = lines.where((paths.basename(F.col("path")) == "package.json") & F.col("line").rlike(r'^\s*"[^"]+"\s*:\s*"([~^][^"]*|\*)"')).withColumn("s", F.trim("line"))
    return reduce(DataFrame.unionByName, [_found(bare, "unpinned_dep_scan", F.col("s"), "MEDIUM"), _found(loose, "unpinned_dep_scan", F.col("s"), "LOW", "WARN"), _found(npm, "unpinned_dep_scan", F.col("s"), "LOW", "WARN")])


def stale_markers(lines: DataFrame) -> DataFrame:
    """stale_migration_marker: comments that promise a migration."""
    return _found(lines.where(F.col("line").rlike(r"(?i)(#|//).*(todo:?\s*migrate|\blegacy\b|old path|\bDEPRECATED\b)")), "stale_migration_marker", F.trim("line"), "LOW", "WARN")


def embedded_newlines(lines: DataFrame) -> DataFrame:
    """embedded_string.unescaped_newline: a single newline escape in files that hold scripts or styles."""
    here = lines.where(F.col("path").rlike(r"(_js\.py|_css\.py|_assets[^/]*)$") & F.col("line").rlike(r"(?<!\\)\\n(?!\\)"))
    return _found(here, "embedded_string.unescaped_newline", F.trim("line"), "MEDIUM")


def encodings(raw: DataFrame) -> DataFrame:
    """encoding_scan over (path, content): BOM, invalid UTF-8, mixed line ends, bare CR, NUL near the start."""
    h = F.hex("content")
    text = F.decode("content", "ISO-8859-1")
    bad = F.array_compact(
        F.array(
            F.when(h.startswith("EFBBBF"), "BOM"), F.when(~F.is_valid_utf8(F.expr("CAST(content AS STRING)")), "invalid UTF-8"), F.when(text.contains("\r\n") & text.rlike("(?<!\r)\n"), "mixed line ends"),
            F.when(text.rlike("\r(?!\n)"), "bare CR"), F.when(F.substring(text, 1, 1000).contains("\x00"), "NUL"),
        )
    )
    return _found(raw.withColumn("what", F.explode(bad)).withColumn("line_no", F.lit(1)), "encoding_scan", F.col("what"), "MEDIUM")


def all_checks(lines: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [f(lines) for f in (log_levels, naming, unchecked_responses, commented_code, magic_numbers, log_without_context, resource_leaks, unpinned, stale_markers, embedded_newlines)])
