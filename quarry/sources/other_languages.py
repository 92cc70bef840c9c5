"""Facts of Go, Java, JavaScript, TypeScript and Swift files, in the shape of the Python facts.

There is no parser for these languages here. A lexer takes comments out, keeping lines and strings; statements over several
lines in brackets are joined; patterns then find imports, symbols, contracts, writes, settings and effects. What a pattern
can't see (types inferred by a compiler, names made at run time) is not found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.session import ship
from quarry.sources.python_facts import SCHEMA

LANGUAGES = ("javascript", "typescript", "go", "java", "swift")
_NAME = r"[A-Za-z_$][\w$]*"
_STRING = r"""["'`]([^"'`\n]*)["'`]"""
IMPORTS = {
    "javascript": [rf"\b(?:import|export)\b[^;'\"`]*?\bfrom\s*{_STRING}", rf"\bimport\s*{_STRING}", rf"\brequire\s*\(\s*{_STRING}\s*\)", rf"\bimport\s*\(\s*{_STRING}\s*\)"],
    "go": [r'^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"'],
    "java": [r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"],
    "swift": [r"^\s*(?:@\w+\s+)*import\s+(?:(?:class|struct|enum|protocol|func|var|let|typealias)\s+)?([\w.]+)"],
}
SYMBOLS = {
    "javascript": [rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function\*?|class|interface|type|enum|namespace)\s+({_NAME})", rf"^(?:export\s+)?(const|let|var)\s+({_NAME})"],
    "go": [r"^(func)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", r"^(type|var|const)\s+([A-Za-z_]\w*)"],
    "java": [r"\b(class|interface|enum|record|@interface)\s+([A-Za-z_]\w*)"],
    "swift": [r"\b(class|struct|enum|protocol|actor|func|extension|typealias)\s+([A-Za-z_]\w*)"],
}
#: Head of a contract with its fields in braces, and a field.
CONTRACTS = {
    "typescript": [(rf"\b(interface)\s+({_NAME})[^{{]*\{{", rf"^\s*(?:readonly\s+)?({_NAME})\??\s*:\s*([^;,]+)"), (rf"\b(type)\s+({_NAME})[^={{]*=\s*\{{", rf"^\s*(?:readonly\s+)?({_NAME})\??\s*:\s*([^;,]+)"), (rf"\bconst\s+(?=({_NAME})\s*=\s*z\.object)({_NAME})\s*=\s*z\.object\(\s*\{{", rf"^\s*({_NAME})\s*:\s*(z\.[^,]+)")],
    "go": [(r"\btype\s+(?=([A-Z_a-z]\w*)\s+(?:struct|interface))([A-Za-z_]\w*)\s+(?:struct|interface)\s*\{", r"^\s*([A-Za-z_]\w*)(?:\([^)]*\))?\s+([\w.\[\]*]+)")],
    "java": [(r"\b(record)\s+([A-Za-z_]\w*)\s*\(", r"(?:^|,)\s*([\w<>\[\]]+)\s+([A-Za-z_]\w*)")],
    "swift": [(r"\b(struct|class|protocol|enum)\s+([A-Za-z_]\w*)[^{]*\{", r"^\s*(?:public\s+|private\s+)?(?:var|let|case)\s+([A-Za-z_]\w*)\s*:?\s*([^={]*)")],
}
#: Calls that write, with the place of the target's argument.
WRITES = {
    "javascript": r"\b(?:fs|fsp|fs\.promises|promises)\.(writeFile|writeFileSync|appendFile|appendFileSync|createWriteStream|outputFile|outputJson)\s*\(\s*([\w.]+\([^()]*\)|[^,)]+)",
    "go": r"\b(?:os|ioutil)\.(WriteFile|Create|OpenFile)\s*\(\s*([\w.]+\([^()]*\)|[^,)]+)",
    "java": r"(?:\bFiles\.(write|writeString|newBufferedWriter)|\bnew\s+(?:FileWriter|FileOutputStream|PrintWriter))\s*\(\s*([\w.]+\([^()]*\)|[^,)]+)",
    "swift": r"\.(write|createFile)\s*\(\s*(?:to|toFile|atPath)\s*:\s*([\w.]+\([^()]*\)|[^,)]+)",
}
ENVS = {"javascript": rf"\bprocess\.env(?:\.({_NAME})|\[\s*{_STRING}\s*\])", "go": r'\bos\.(?:Getenv|LookupEnv)\(\s*"([^"]+)"', "java": r'\bSystem\.getenv\(\s*"([^"]+)"', "swift": r'ProcessInfo\.processInfo\.environment\[\s*"([^"]+)"'}
#: Starts of work beside the main flow, timers, listeners, registries.
EFFECTS = {
    "javascript": r"\b(setInterval|setTimeout|addEventListener|process\.on|cron\.schedule|new Worker)\s*\(",
    "go": r"^\s*(go)\s+[\w.]+\(|^func\s+(init)\s*\(",
    "java": r"\b(new Thread|executor\.submit|CompletableFuture\.\w+Async)\s*\(|@(RestController|Service|Component|Repository|Configuration|Scheduled)\b|^\s*(static)\s*\{",
    "swift": r"\b(Task|DispatchQueue\.[\w.()]*async)\s*[{(]|@(main)\b",
}
#: Writes through a database or a store, by its client.
STORES = {"typescript": [(r"\bprisma\.(\w+)\.(?:create|update|upsert|delete)\w*\(", "prisma"), (r"\.from\(\s*['\"](\w+)['\"]\s*\)\s*\.(?:insert|update|upsert|delete)\(", "supabase"), (r"\b(?:localStorage|sessionStorage)\.setItem\(\s*['\"]([^'\"]+)", "storage")]}
ROUTE = r"^\s*export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|middleware)\b"
for _t in (IMPORTS, SYMBOLS, WRITES, ENVS, EFFECTS):
    _t["typescript"] = _t["javascript"]
FORCE = (r"[\w)\]]!(?!=)(?=[\s.,;)\]]|$)", "swift.force_unwrap", "HIGH")
IMPLICIT = (r"\b(?:var|let)\s+\w+\s*:\s*[\w.<>\[\]]+!", "swift.implicitly_unwrapped_optional", "LOW")
_LEX = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)


def without_comments(text: str) -> str:
    """The text with comments blanked; line breaks and strings stay."""
    return _LEX.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][:2] in ("//", "/*") else m[0], text)


def without_strings(text: str) -> str:
    """Also with the insides of strings blanked."""
    return _LEX.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][:2] in ("//", "/*") else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1], text)


def joined(text: str) -> Iterator[tuple[int, str]]:
    """(line, statement): import statements in braces or brackets as one line, other lines as they are."""
    held, first = "", 0
    for n, line in enumerate(text.split("\n"), 1):
        if held:
            held += " " + line.strip()
        elif re.match(r"\s*(?:import|export)\b[^;]*\{[^}]*$|\s*import\s*\($", line) and "=" not in line:
            held, first = line, n
        else:
            yield n, line
            continue
        if held.count("{") <= held.count("}") and held.count("(") <= held.count(")"):
            yield first, held
            held = ""
    if held:
        yield first, held


def brace_imbalance(text: str) -> tuple[int, str] | None:
    """(line, what) of the first bracket outside strings and comments that doesn't pair."""
    pairs, stack = {")": "(", "}": "{", "]": "["}, []
    for n, line in enumerate(without_strings(text).split("\n"), 1):
        for c in line:
            if c in "({[":
                stack.append((c, n))
            elif c in pairs:
                if not stack or stack.pop()[0] != pairs[c]:
                    return n, f"unmatched {c}"
    return (stack[-1][1], f"unclosed {stack[-1][0]}") if stack else None


def _block(text: str, at: int, close: str) -> str:
    """The text up to the bracket that closes what opened before `at`."""
    depth, open_ = 1, {"}": "{", ")": "("}[close]
    for i in range(at, len(text)):
        depth += (text[i] == open_) - (text[i] == close)
        if not depth:
            return text[at:i]
    return text[at:]


def _target(expr: str, known: dict[str, str]) -> tuple[str, str]:
    """(path, provenance) of a target: a literal, a name that holds one, or names and literals joined."""
    expr = expr.strip()
    if m := re.fullmatch(_STRING, expr):
        return m[1], "unknown"
    if expr in known:
        return known[expr], "string_literal"
    if m := re.match(r"(?:path|filepath)\.(?:join|Join|resolve)\((.*)\)?$|(?:Path\.of|Paths\.get|new File)\((.*)\)?$|URL\(fileURLWithPath:\s*(.*)\)?$", expr):
        parts = [_target(x.rstrip(")"), known)[0] for x in re.split(r"\s*,\s*", next(x for x in m.groups() if x is not None))]
        if parts and all(parts):
            return "/".join(parts), "path_constructor"
    return "", "unknown"


def extract(path: str, text: str, language: str) -> list[tuple]:
    rows: list[tuple] = []
    text = text.removeprefix("\ufeff")
    code = without_comments(text)

    def add(fact: str, line: int, name: str, items=(), **attrs) -> None:
        rows.append((path, fact, line, line, name, "", {k: str(v) for k, v in attrs.items()}, list(items)))

    if language != "swift" and (bad := brace_imbalance(text)):
        add("syntax_error", bad[0], bad[1])
    known: dict[str, str] = {}
    for m in re.finditer(rf"\b(?:const|let|var|final\s+\w+|String)\s+({_NAME})\s*(?::\s*\w+\s*)?(?::=|=)\s*{_STRING}|^\s*({_NAME})\s*:=\s*{_STRING}", code, re.M):
        known[m[1] or m[3]] = m[2] if m[1] else m[4]
    seen = set()

    def imported(line: int, name: str) -> None:
        if name not in seen:
            seen.add(name)
            add("import", line, name, kind="import", bound="", asname="", in_function=False)

    depth, group = 0, False
    for n, line in joined(code):
        for p in IMPORTS[language]:
            for m in re.finditer(p, line):
                imported(n, m[1])
        if language == "go":
            if m := re.match(r"\s*import\s*\((.*)\)?", line):
                for name in re.findall(r'"([^"]+)"', m[1]):
                    imported(n, name)
                group = ")" not in line
            elif group:
                for name in re.findall(r'"([^"]+)"', line):
                    imported(n, name)
                group = ")" not in line
        for p in SYMBOLS[language]:
            for m in re.finditer(p, line):
                public = m[2][0].isupper() if language == "go" else "private" not in line if language in ("java", "swift") else line.lstrip().startswith("export")
                add("bound", n, m[2])
                add("symbol", n, m[2], kind="function" if m[1].startswith("func") else "class" if m[1] in ("class", "struct", "interface", "type", "enum", "record", "protocol", "actor") else m[1], visibility="public" if public else "private")
        for m in re.finditer(ENVS[language], line):
            add("env", n, next(x for x in m.groups() if x), guarded=True)
        for m in re.finditer(WRITES[language], line):
            where, how = _target(m[2], known)
            add("write", n, where, kind=m[1] or "new", provenance=how, hint=m[2].strip()[:80])
        for p, kind in STORES.get(language, []):
            for m in re.finditer(p, line):
                add("write", n, f"{kind}:{m[1]}", kind=kind, provenance="string_literal", hint=m[1])
        for m in re.finditer(EFFECTS[language], line):
            name = next(x for x in m.groups() if x)
            add("call", n, name, n_args=0, loops=0, at_module=depth == 0, awaited=False, in_function=depth > 0, in_async=False, background=True)
            if depth == 0 and language in ("javascript", "typescript"):
                add("side_effect", n, name)
        if language in ("javascript", "typescript") and (m := re.match(ROUTE, line)):
            add("decorator", n, "route", of=m[1], args=0)
        if language == "go" and re.match(r"func\s+main\s*\(", line) or language == "java" and "public static void main" in line or language == "swift" and "@main" in line:
            add("main", n, "__main__")
        depth = max(0, depth + line.count("{") - line.count("}"))
    flat = without_strings(text)
    for head, field in CONTRACTS.get(language, []):
        for m in re.finditer(head, flat):
            body = _block(flat, m.end(), ")" if m[0].endswith("(") and not m[0].endswith("({") and language == "java" else "}")
            if language == "java":
                fields = [f"{b}:{a}" for a, b in re.findall(field, body)]
            else:
                fields = [f"{a}:{b.strip()}" for a, b in re.findall(field, body, re.M)]
            add("contract", flat[: m.start()].count("\n") + 1, m[2], fields, kind=m[1] or "struct", required=",".join(f.split(":")[0] for f in fields))
    return rows


def facts(files: DataFrame) -> DataFrame:
    """The facts of all files of these languages, in the schema of the Python facts."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, text, language in zip(b["path"], b["text"], b["language"], strict=True):
                try:
                    rows += extract(path, text, language)
                except RecursionError as e:
                    rows.append((path, "too_deep", 1, 1, str(e)[:200], "", {}, []))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    ship(files.sparkSession)
    own = files.withColumn("language", paths.language(F.col("path"))).where(F.col("text").isNotNull() & F.col("language").isin(*LANGUAGES))
    return own.select("path", "text", "language").mapInPandas(run, SCHEMA)


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) of ./, ../ and @/ imports: the first that is there of .ts, .tsx, .js, .jsx, then index files in that order."""
    ends = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    i = imports.where(F.col("name").rlike(r"^(\.\.?/|@/)")).select(F.col("path").alias("src"), "name").distinct()
    folder = F.slice(F.split("src", "/"), 1, F.size(F.split("src", "/")) - 1)
    # Each .. takes a folder away, each name adds one.
    walked = F.aggregate(F.split("name", "/"), F.when(F.col("name").startswith("@/"), F.array().cast("array<string>")).otherwise(folder), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p.isin(".", "@", ""), acc).otherwise(F.concat(acc, F.array(p))))
    tries = i.withColumn("base", F.array_join(walked, "/")).select("src", "name", F.posexplode(F.concat(F.array("base"), F.transform(F.array(*map(F.lit, ends)), lambda e: F.concat("base", e)))).alias("pos", "dst"))
    return tries.join(files.select(F.col("path").alias("dst")), "dst").groupBy("src", "name").agg(F.min_by("dst", "pos").alias("dst")).select("src", "dst").distinct()


def swift_checks(lines: DataFrame) -> DataFrame:
    """swift.force_unwrap and swift.implicitly_unwrapped_optional outside tests; a type's own mark is no unwrap."""
    own = lines.where((paths.extension(F.col("path")) == "swift") & ~paths.is_test(F.col("path")) & ~F.lower("path").contains("test") & ~F.ltrim("line").startswith("//"))
    row = lambda df, check, severity: df.select(F.lit(check).alias("check_id"), "path", "line_no", F.trim("line").alias("detail"), F.lit(severity).alias("severity"), F.lit("REVISE").alias("impact"))
    bare = F.regexp_replace(F.regexp_replace("line", IMPLICIT[0], ""), r'"(?:\\.|[^"\\])*"', '""')
    return row(own.where(bare.rlike(FORCE[0])), FORCE[1], FORCE[2]).unionByName(row(own.where(F.col("line").rlike(IMPLICIT[0])), IMPLICIT[1], IMPLICIT[2]))
