"""Columns over paths: language, role, test files, globs, identities."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "swift": "swift", "rs": "rust", "sh": "shell",
}
# Roles by a part of the lower-cased path, the first that holds.
ROLES = [
    ("fixture", ["/fixtures/", "/snapshots/", "/mocks/"]),
    ("test", ["/tests/", "/test/", "test_", "_test.py", "/conftest.py"]),
    ("generated", ["/generated/", "/migrations/", "/alembic/"]),
]
# Parts of the path of test files, by language.
TESTS = {
    "python": ["test_", "_test.py"], "javascript": [".test.js", ".spec.js", "__tests__/"], "typescript": [".test.ts", ".spec.ts", "__tests__/"],
    "go": ["_test.go"], "java": ["Test.java", "Tests.java", "/test/"], "swift": ["Tests.swift", "Test.swift", "/Tests/"],
}
# Folders that an audit leaves out, those that the maps leave out, and subtrees of the root.
EXCLUDED = [
    "__pycache__", ".git", ".venv", "venv", ".cortex", "node_modules", "libs", ".pytest_cache", "build", "dist", ".mypy_cache", ".ruff_cache", ".tox",
    "site-packages", "dist-packages", ".eggs", ".next", ".claude", ".codex", ".prompt-engineer", ".a1",
]
MAP_EXCLUDED = [".git", "__pycache__", ".venv", "venv", "env", "node_modules", ".tox", "build", "dist", ".pytest_cache", ".mypy_cache", ".ruff_cache", "site-packages", "dist-packages", ".eggs", ".next", ".cortex", ".claude", ".codex", ".prompt-engineer", ".a1"]
MAP_SUBTREES = ["SYSTEM/libs/", ".claude/", ".codex/"]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"\.([^.]+)$", 1)


def language(path: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for k, v in LANGUAGES.items() for x in (k, v)])
    return F.try_element_at(pairs, extension(path))


def role(path: Column) -> Column:
    low = F.lower(path)
    out = F.when(F.lit(False), "")
    for name, parts in ROLES:
        hit = F.lit(False)
        for p in parts:
            hit = hit | low.contains(p)
        out = out.when(hit, name)
    return out.otherwise("production")


def is_test(path: Column) -> Column:
    """A part of the path names a test file of its language; false for other languages."""
    lang = language(path)
    out = F.lit(False)
    for name, parts in TESTS.items():
        hit = F.lit(False)
        for p in parts:
            hit = hit | path.contains(p)
        out = F.when(lang == name, hit).otherwise(out)
    return out


def is_generated(path: Column) -> Column:
    return role(F.concat(F.lit("/"), path)) == "generated"


def package_root(path: Column) -> Column:
    """The first folder of a path; "src" and the like give the second, as the package stands in them."""
    p = F.split(path, "/")
    return F.when(F.size(p) < 2, F.lit(None)).when(p[0].isin("src", "lib", "python"), F.when(F.size(p) > 2, p[1])).otherwise(p[0])


def wanted(path: Column, excluded: list[str] = EXCLUDED, subtrees: list[str] = [], roots: list[str] | None = None) -> Column:  # noqa: B006
    """No excluded folder or subtree on the way, a known extension, and, where `roots` are given, under one of them."""
    out = ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in excluded])) & language(path).isNotNull()
    for x in subtrees:
        out = out & ~path.startswith(x)
    return out if roots is None else out & F.split(path, "/")[0].isin(*roots)


def in_maps(path: Column, roots: list[str] | None = None) -> Column:
    """Files that the maps cover."""
    return wanted(path, MAP_EXCLUDED, MAP_SUBTREES, roots)


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: * also crosses /, ** is zero or more segments, ? one character."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob[i] == "*":
            out.append(".*")
            i += 2 if glob.startswith("**", i) else 1
        else:
            out.append("." if glob[i] == "?" else re.escape(glob[i]))
            i += 1
    return "^" + "".join(out) + "$"


def short_hash(n: int, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, n)


def module_names(files: DataFrame) -> DataFrame:
    """(path, module) of Python files: the dotted name from the root, and from below src, lib or python."""
    p = files.where(F.col("path").endswith(".py")).select("path", F.regexp_replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/", ".").alias("module"))
    return p.union(p.where(F.col("module").rlike(r"^(src|lib|python)\.")).select("path", F.regexp_replace("module", r"^(src|lib|python)\.", "")))
