"""Gates that a project brings: code with run_check(path, content) that may import nothing but re."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.session import ship

SCHEMA = "check_id string, path string, line_no int, detail string, severity string, impact string"
#: What the feature returns at most: findings of a gate, and of all gates.
PER_GATE, IN_ALL = 20, 100
SAFE = "abs all any bool dict enumerate filter float frozenset int isinstance len list map max min range repr reversed round set sorted str sum tuple zip".split()
NAMES = {"eval", "exec", "compile", "open", "__import__", "globals", "locals", "vars", "getattr", "setattr", "delattr", "input", "breakpoint"}


def errors(code: str) -> list[str]:
    """Why a gate's code is not run; none if it may."""
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        return [f"syntax: {e.msg}"]
    out = []
    for x in ast.walk(tree):
        if isinstance(x, ast.Import) and any(a.name != "re" for a in x.names) or isinstance(x, ast.ImportFrom) and x.module != "re":
            out.append(f"import at {x.lineno}")
        elif isinstance(x, ast.Name) and x.id in NAMES or isinstance(x, ast.Attribute) and x.attr.startswith("_") or isinstance(x, ast.Name) and x.id.startswith("__"):
            out.append(f"name at {x.lineno}")
    if not any(isinstance(s, ast.FunctionDef) and s.name == "run_check" and len(s.args.args) == 2 for s in tree.body):
        out.append("no run_check(path, content)")
    return out


def inventory(gates: dict[str, str]) -> list[tuple[str, list[str]]]:
    """Each gate with what is wrong with it."""
    return [(name, errors(code)) for name, code in sorted(gates.items())]


def run(files: DataFrame, gates: dict[str, str]) -> DataFrame:
    """Findings of the gates that may run, over all files: the first PER_GATE of each and IN_ALL together, by path and line.
    run_check returns (line, text) pairs; one that raises on a file gives a finding there."""
    good = {name: code for name, bad in inventory(gates) if not bad for code in [gates[name]]}

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import builtins

        allowed = {n: getattr(builtins, n) for n in SAFE} | {"__import__": lambda name, *a: re if name == "re" else (_ for _ in ()).throw(ImportError(name))}
        made = {}
        for name, code in good.items():
            made[name] = {"__builtins__": allowed}
            exec(compile(code, name, "exec"), made[name])  # noqa: S102  checked above
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                for name, space in made.items():
                    try:
                        rows += [(name, path, int(n), str(t), "MEDIUM", "REVISE") for n, t in space["run_check"](path, text)]
                    except Exception as e:  # the gate's own fault
                        rows.append((f"internal_failure.{name}", path, 1, f"{type(e).__name__}: {e}", "HIGH", "REVISE"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    ship(files.sparkSession)
    found = files.where("text IS NOT NULL").select("path", "text").mapInPandas(check, SCHEMA)
    nth = F.row_number().over(W.partitionBy("check_id").orderBy("path", "line_no", "detail"))
    return found.withColumn("nth", nth).where(F.col("nth") <= PER_GATE).drop("nth").orderBy("check_id", "path", "line_no").limit(IN_ALL)
