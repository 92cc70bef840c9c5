"""Checks of single lines, from one table of rules.

A rule names its check, the languages it holds for (empty: all), the pattern, and what it says. Of the rules of one
check with `first`, the first that matches a line counts; of others each counts. All hits are returned; caps are the
report's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths

PY, JS, PATHS = ("python",), ("javascript", "typescript"), ("python", "javascript", "typescript", "go", "rust", "java", "shell")


@dataclass(frozen=True)
class Rule:
    check: str
    detail: str
    pattern: str
    severity: str
    impact: str = "REVISE"
    languages: tuple[str, ...] = ()
    and_also: str = ""
    but_not: str = ""


# Patterns of the checks.
RULES = [
    Rule("secrets_scan", "Hardcoded password", r"""(?i)(?:password|passwd|pwd)\s*=\s*['"][^'"]{4,}['"]""", "CRITICAL", "BLOCK"),
    Rule("secrets_scan", "Hardcoded API key", r"""(?i)(?:api_key|apikey|api_secret)\s*=\s*['"][^'"]{8,}['"]""", "CRITICAL", "BLOCK"),
    Rule("secrets_scan", "Hardcoded secret/token", r"""(?i)(?:secret|token|auth)\s*=\s*['"][A-Za-z0-9+/=]{16,}['"]""", "CRITICAL", "BLOCK"),
    Rule("secrets_scan", "OpenAI-style API key", r"(?i)sk-[a-zA-Z0-9]{20,}", "CRITICAL", "BLOCK"),
    Rule("secrets_scan", "GitHub personal access token", r"(?i)ghp_[a-zA-Z0-9]{36,}", "CRITICAL", "BLOCK"),
    Rule("secrets_scan", "GitLab personal access token", r"(?i)glpat-[a-zA-Z0-9\-]{20,}", "CRITICAL", "BLOCK"),
    Rule("secrets_scan", "AWS access key ID", r"(?i)AKIA[0-9A-Z]{16}", "CRITICAL", "BLOCK"),
    Rule("secrets_scan", "Private key in source", r"(?i)-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----", "CRITICAL", "BLOCK"),
    Rule("secrets_scan", "Database connection string with credentials", r"""(?i)(?:mongodb|postgres|mysql|redis)://[^'"\s]+:[^'"\s]+@""", "CRITICAL", "BLOCK"),
    Rule("test_secret_scan", "Stripe-like API key", r"(?:sk|pk)[-_](?:live|test)[-_][a-zA-Z0-9]{20,}", "HIGH"),
    Rule("test_secret_scan", "GitHub personal access token", r"ghp_[a-zA-Z0-9]{36,}", "HIGH"),
    Rule("test_secret_scan", "GitHub OAuth token", r"gho_[a-zA-Z0-9]{36,}", "HIGH"),
    Rule("test_secret_scan", "AWS access key ID", r"AKIA[A-Z0-9]{16}", "HIGH"),
    Rule("test_secret_scan", "JWT token", r"eyJ[a-zA-Z0-9_-]{20,}\.[a-zA-Z0-9_-]{20,}\.[a-zA-Z0-9_-]{20,}", "HIGH"),
    Rule("test_secret_scan", "Slack token", r"xox[bpsar]-[a-zA-Z0-9-]{20,}", "HIGH"),
    Rule("test_secret_scan", "OpenAI API key", r"sk-[a-zA-Z0-9]{40,}", "HIGH"),
    Rule("test_secret_scan", "Google API key", r"AIza[a-zA-Z0-9_-]{35}", "HIGH"),
    Rule("error_msg_scan", "generic message", r"""(?i)raise\s+\w+Error\s*\(\s*["'](?:error|failed|bad|invalid|wrong|oops|problem|issue)["']""", "LOW", "WARN"),
    Rule("error_msg_scan", "short message", r"""(?i)raise\s+Exception\s*\(\s*["'][^"']{0,10}["']""", "LOW", "WARN"),
    Rule("error_msg_scan", "empty error", r"(?i)raise\s+\w+Error\s*\(\s*\)\s*$", "LOW", "WARN"),
    Rule("error_msg_scan", "empty exception", r"(?i)raise\s+Exception\s*\(\s*\)\s*$", "LOW", "WARN"),
    Rule("todo_scan", "TODO", r"(?i)\bTODO\b", "INFO", "WARN"),
    Rule("todo_scan", "FIXME", r"(?i)\bFIXME\b", "INFO", "WARN"),
    Rule("todo_scan", "HACK", r"(?i)\bHACK\b", "INFO", "WARN"),
    Rule("todo_scan", "XXX", r"(?i)\bXXX\b", "INFO", "WARN"),
    Rule("todo_scan", "TEMP", r"(?i)\bTEMP\b", "INFO", "WARN"),
    Rule("todo_scan", "WORKAROUND", r"(?i)\bWORKAROUND\b", "INFO", "WARN"),
    Rule("todo_scan", "KLUDGE", r"(?i)\bKLUDGE\b", "INFO", "WARN"),
    Rule("hardcoded_path_scan", "Windows absolute path", r"""["'][A-Z]:\\[^"']{3,}["']""", "MEDIUM", languages=PATHS),
    Rule("hardcoded_path_scan", "Unix home directory path", r"""["']/home/\w+[^"']*["']""", "MEDIUM", languages=PATHS),
    Rule("hardcoded_path_scan", "Hardcoded /tmp path (use tempfile)", r"""["']/tmp/[^"']+["']""", "MEDIUM", languages=PATHS),
    Rule("hardcoded_path_scan", "Hardcoded /usr path", r"""["']/usr/(?:local/|bin/)[^"']+["']""", "MEDIUM", languages=PATHS),
    Rule("hardcoded_path_scan", "Hardcoded /var path", r"""["']/var/(?:log|run|lib)/[^"']+["']""", "MEDIUM", languages=PATHS),
    Rule("hardcoded_path_scan", "Hardcoded /etc config path", r"""["']/etc/[^"']+["']""", "MEDIUM", languages=PATHS),
    Rule("hardcoded_path_scan", "Hardcoded /opt path", r"""["']/opt/[^"']+["']""", "MEDIUM", languages=PATHS),
    Rule("hardcoded_path_scan", "Hardcoded system path", r"""["']/(?:root|srv|mnt)/[^"']+["']""", "MEDIUM", languages=PATHS),
    Rule("boundary_validation_scan", "command injection: os.system/popen with f-string", r"""os\.(system|popen)\s*\(\s*f["']""", "HIGH", languages=PY),
    Rule("boundary_validation_scan", "command injection: shell=True with f-string", r"subprocess\.\w+\s*\(.*shell\s*=\s*True", "HIGH", languages=PY, and_also=r"""f["']"""),
    Rule("boundary_validation_scan", "SQL injection: f-string", r"""\.(execute|executemany|query)\s*\(\s*f["']""", "HIGH", languages=PY, and_also=r"(?i)(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)"),
    Rule("boundary_validation_scan", "SQL injection: % formatting", r"""\.(execute|query)\s*\(\s*["'].*%s.*["'].*%\s*\(""", "HIGH", languages=PY, and_also=r"(?i)(SELECT|INSERT|UPDATE|DELETE)"),
    Rule("boundary_validation_scan", "eval/exec with variable input", r"""\b(eval|exec)\s*\(\s*(?!["'(])""", "HIGH", languages=PY),
    Rule("timezone_scan", "datetime.now() without timezone", r"datetime\.now\s*\(\s*\)", "MEDIUM", languages=PY),
    Rule("timezone_scan", "datetime.utcnow() is deprecated", r"datetime\.utcnow\s*\(", "MEDIUM", languages=PY),
    Rule("timezone_scan", "time.localtime() without timezone", r"time\.localtime\s*\(\s*\)", "LOW", "WARN", PY),
    Rule("timezone_scan", "toLocaleDateString() without locale", r"\.toLocaleDateString\s*\(\s*\)", "LOW", "WARN", JS),
    Rule("null_check_scan", "request.json[key] without .get()", r"request\.json\s*\[", "MEDIUM", languages=PY),
    Rule("null_check_scan", "request.form[key] without .get()", r"request\.form\s*\[", "MEDIUM", languages=PY),
    Rule("null_check_scan", "json.loads()[key]", r"json\.loads\s*\([^)]+\)\s*\[", "MEDIUM", languages=PY),
    Rule("null_check_scan", "req.body.field without null check", r"req\.body\.\w+", "MEDIUM", languages=JS, but_not=r"\?\.|if\s*\(.*req\.body"),
    Rule("null_check_scan", "JSON.parse().field", r"JSON\.parse\s*\([^)]+\)\.\w+", "MEDIUM", languages=JS),
    Rule("path_concat_scan", "string concat for path building", r"""\w+\s*\+\s*["'][/\\]["']""", "LOW", "WARN", (*PY, *JS), and_also=r"(?i)path|dir|file|folder|name|root|base", but_not=r"https?://"),
    Rule("path_concat_scan", "f-string path building", r"""f["'][^"']*\{[^}]+\}/\{[^}]+\}""", "LOW", "WARN", PY, but_not=r"https?://"),
]
#: Checks where the first matching rule of a line counts.
FIRST = {"secrets_scan", "test_secret_scan", "error_msg_scan", "todo_scan", "boundary_validation_scan"}
# Words that mark a line as no true secret.
PLACEHOLDERS = {"secrets_scan": "example|placeholder|xxx|changeme|your_|test_key|<your|fake", "test_secret_scan": "placeholder|example|fake|mock|dummy|xxx|test_key", "hardcoded_path_scan": "example|placeholder"}
ONLY_TESTS, NO_TESTS = {"test_secret_scan"}, {"error_msg_scan", "hardcoded_path_scan", "boundary_validation_scan", "timezone_scan", "null_check_scan", "path_concat_scan"}


def _applies(check: str) -> Column:
    s = F.ltrim("line")
    ok = ~s.startswith("#") if check != "todo_scan" else ~s.rlike(r"^(#|//)\s*[-=*#]{3,}")
    if check == "secrets_scan":
        ok = ok & ~s.startswith("//") & ~s.startswith("*")
    if check in ("test_secret_scan", "hardcoded_path_scan", "path_concat_scan", "timezone_scan", "null_check_scan"):
        ok = ok & ~s.startswith("//")
    if check == "hardcoded_path_scan":
        ok = ok & ~s.rlike("^(\"\"\"|''')") & ~F.col("line").rlike("(https?|ftp)://")
    if check in PLACEHOLDERS:
        ok = ok & ~F.lower("line").rlike(PLACEHOLDERS[check])
    if check in ONLY_TESTS:
        ok = ok & paths.is_test(F.col("path"))
    if check in NO_TESTS:
        ok = ok & ~paths.is_test(F.col("path"))
    return ok


def check_lines(lines: DataFrame, checks: list[str] | None = None, any_language: bool = False) -> DataFrame:
    """(check_id, path, line_no, detail, severity, impact) of every hit; lines are read once for all checks."""
    names = [c for c in dict.fromkeys(r.check for r in RULES) if checks is None or c in checks]
    lang = paths.language(F.col("path"))
    parts = []
    for name in names:
        hits = []
        for r in (r for r in RULES if r.check == name):
            hit = F.col("line").rlike(r.pattern)
            if r.and_also:
                hit = hit & F.col("line").rlike(r.and_also)
            if r.but_not:
                hit = hit & ~F.col("line").rlike(r.but_not)
            if r.languages and not any_language:
                hit = hit & F.coalesce(lang.isin(*r.languages), F.lit(False))
            hits.append(F.when(hit, F.struct(F.lit(name).alias("check_id"), F.lit(r.detail).alias("detail"), F.lit(r.severity).alias("severity"), F.lit(r.impact).alias("impact"))))
        found = F.array(F.coalesce(*hits)) if name in FIRST else F.array(*hits)
        parts.append(F.when(_applies(name), found).otherwise(F.array().cast("array<struct<check_id:string,detail:string,severity:string,impact:string>>")))
    rows = lines.select("path", "line_no", F.explode(F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull())).alias("f"))
    return rows.select("f.check_id", "path", "line_no", "f.detail", "f.severity", "f.impact")


def candidates(files: DataFrame, checks: list[str]) -> DataFrame:
    """Files in which some rule of the checks may match a line: a look at whole texts before they are split. Rules that
    need a line's end are left to the lines."""
    rules = [r.pattern for r in RULES if r.check in checks]
    if any(p.endswith("$") for p in rules):
        return files
    return files.where(F.col("text").rlike("|".join(f"(?:{p})" for p in rules)))


def too_many_todos(hits: DataFrame, most: int = 5) -> DataFrame:
    """Files with more than `most` debt markers."""
    return hits.where("check_id = 'todo_scan'").groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > most)
