"""Facts of Python files, from one pass over their syntax trees.

facts(path, fact, line, end_line, name, scope, attrs, items): a row for each import, symbol, function, call, handler,
write, contract, env read and so on. Every check and map reads these rows; none parses code itself. A file that
doesn't parse gives one row `syntax_error`, one whose tree is too deep for it `too_deep`. Rules over one function or file
(local_rules) give rows `hit`. Attributes `preview` and `first` show how a node begins; no check decides by them.
"""

from __future__ import annotations

import ast
import hashlib
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.session import ship
from quarry.sources import local_rules

SCHEMA = "path string, fact string, line int, end_line int, name string, scope string, attrs map<string,string>, items array<string>"
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_NESTS = (ast.For, ast.AsyncFor, ast.While, ast.If, ast.With, ast.AsyncWith, ast.Try, ast.Match)
_FUNCS = (ast.FunctionDef, ast.AsyncFunctionDef)
# How SQL that is built at run time begins, and names of data held out.
_SQL = re.compile(r"(?is)\bselect\b.+\bfrom\b|\binsert\s+into\b|\bupdate\b.+\bset\b|\bdelete\s+from\b|\b(?:drop|create|alter)\s+table\b")
_HELD_OUT = re.compile(r"(?i)test|val|valid|holdout|oot")
#: Depth of Python calls a tree may take.
DEEP = 50_000


def dotted(node: ast.AST | None) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    if isinstance(node, ast.Call):
        return dotted(node.func)
    return ""


def _text(node: ast.AST | None) -> str:
    return ast.unparse(node) if node is not None else ""


class _Visitor(ast.NodeVisitor):
    def __init__(self, path: str):
        self.path, self.rows = path, []
        self.scope: list[str] = []
        self.functions: list[ast.AST] = []
        self.classes = self.loops = self.depth = self.deepest = 0
        self.deepest_line = 1
        self.quiet: set[str] = set()
        self.paths: dict[str, tuple[str, str]] = {}

    def add(self, fact: str, node: ast.AST | None, name: str, items=(), **attrs) -> None:
        at = getattr(node, "lineno", 1)
        self.rows.append((self.path, fact, at, getattr(node, "end_lineno", at), name, ".".join(self.scope), {k: str(v) for k, v in attrs.items()}, list(items)))

    def visit(self, node: ast.AST):
        for block in ("body", "orelse", "finalbody"):
            if isinstance(b := getattr(node, block, None), list):
                self._unreachable(b)
        nests = isinstance(node, _NESTS)
        self.depth += nests
        if self.depth > self.deepest:
            self.deepest, self.deepest_line = self.depth, node.lineno
        super().visit(node)
        self.depth -= nests

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", node, a.name, kind="import", bound=a.asname or a.name.split(".")[0], asname=a.asname or "", in_function=bool(self.functions))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = "." * node.level + (node.module or "")
        self.add("import", node, base, kind="from", bound="", asname="", in_function=bool(self.functions))
        for a in node.names:
            if a.name != "*":
                self.add("import", node, f"{base}.{a.name}" if node.module else base + a.name, kind="member", bound=a.asname or a.name, asname=a.asname or "", in_function=bool(self.functions))
                self.add("bound", node, a.asname or a.name)
            else:
                self.add("star", node, base)

    def _function(self, node) -> None:
        a = node.args
        params = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]]
        hinted = all(x.annotation is not None for x in [*a.posonlyargs, *a.args, *a.kwonlyargs] if x.arg not in ("self", "cls")) and node.returns is not None
        body = [s for s in node.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
        asserts = [x for x in ast.walk(node) if isinstance(x, ast.Assert) or isinstance(x, ast.Call) and (dotted(x.func).rpartition(".")[2].startswith("assert") or dotted(x.func).endswith("raises"))]
        literal = bool(asserts) and all(isinstance(x, ast.Assert) and not any(isinstance(y, (ast.Name, ast.Call, ast.Attribute)) for y in ast.walk(x.test)) for x in asserts)
        self.add(
            "function", node, node.name, params, is_async=isinstance(node, ast.AsyncFunctionDef), is_method=bool(self.classes), nested=bool(self.functions), hinted=hinted, empty=all(isinstance(s, ast.Pass) for s in body), n_asserts=len(asserts), literal_asserts=literal,
            decorators=",".join(dotted(d) for d in node.decorator_list), required=len([*a.posonlyargs, *a.args]) - len(a.defaults),
        )
        self.add("bound", node, node.name)
        self.add("symbol", node, node.name, kind="function", visibility="private" if node.name.startswith("_") else "public")
        for d in [*a.defaults, *a.kw_defaults]:
            if isinstance(d, (ast.List, ast.Dict, ast.Set)) or isinstance(d, ast.Call) and dotted(d.func) in ("list", "dict", "set"):
                self.add("mutable_default", d, node.name)
        for d in node.decorator_list:
            self.add("decorator", d, dotted(d), attrs_text=_text(d), of=node.name, args=len(d.args) + len(d.keywords) if isinstance(d, ast.Call) else 0)
            self.visit(d)
        if node.end_lineno - node.lineno >= 3 and not node.name.startswith(("test", "__")):
            self.add("normal", node, node.name, hash=hashlib.sha256(local_rules.normal_form(node).encode()).hexdigest())
        self.functions.append(node)
        self.scope.append(node.name)
        # Names of one function are not seen in the next.
        loops, self.loops, known, self.paths = self.loops, 0, self.paths, dict(self.paths)
        for s in node.body:
            self.visit(s)
        self.loops, self.paths = loops, known
        self.scope.pop()
        self.functions.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _unreachable(self, body: list[ast.stmt]) -> None:
        for a, b in zip(body, body[1:], strict=False):
            if isinstance(a, (ast.Return, ast.Raise, ast.Continue, ast.Break)):
                self.add("unreachable", b, type(a).__name__.lower())
                return

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [dotted(b).rpartition(".")[2] for b in node.bases]
        fields = [(s.target.id, _text(s.annotation), s.value is not None) for s in node.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)]
        deco = [dotted(d).rpartition(".")[2] for d in node.decorator_list]
        kind = "dataclass" if "dataclass" in deco else next((b for b in bases if b in ("BaseModel", "TypedDict", "NamedTuple")), "")
        self.add("bound", node, node.name)
        self.add("symbol", node, node.name, kind="class", visibility="private" if node.name.startswith("_") else "public")
        if kind:
            self.add("contract", node, node.name, [f"{n}:{t}" for n, t, _ in fields], kind=kind, required=",".join(n for n, _, d in fields if not d))
        self.scope.append(node.name)
        self.classes += 1
        functions, self.functions = self.functions, []
        # Annotated fields bind nothing outside the class.
        quiet, self.quiet = self.quiet, {n for n, _, _ in fields}
        self.generic_visit(node)
        self.functions, self.quiet = functions, quiet
        self.classes -= 1
        self.scope.pop()

    def visit_For(self, node) -> None:
        self.loops += 1
        self.generic_visit(node)
        self.loops -= 1

    visit_AsyncFor = visit_While = visit_For

    def visit_Await(self, node: ast.Await) -> None:
        if isinstance(node.value, ast.Call):
            node.value._awaited = True
        self.generic_visit(node)

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        types = node.type.elts if isinstance(node.type, ast.Tuple) else [node.type] if node.type else []
        body = [s for s in node.body if not isinstance(s, ast.Pass)]
        silent = len(body) == 1 and isinstance(body[0], ast.Return) and (body[0].value is None or isinstance(body[0].value, ast.Constant) and body[0].value.value is None or isinstance(body[0].value, (ast.Dict, ast.List, ast.Tuple)) and not getattr(body[0].value, "elts", getattr(body[0].value, "keys", [])))
        calls = [dotted(s.value.func) if isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) else "" for s in node.body]
        logged = len(node.body) == 2 and isinstance(node.body[1], ast.Pass) and "." in calls[0] and calls[0].rpartition(".")[2] in ("warning", "warn", "debug", "info")
        self.add(
            "handler", node, ",".join(dotted(t).rpartition(".")[2] for t in types), [type(s).__name__ for s in node.body], bare=node.type is None, reraises=any(isinstance(s, ast.Raise) for s in node.body), silent_return=silent, log_swallow=logged,
            only_pass=all(isinstance(s, (ast.Pass, ast.Continue)) for s in node.body), only_logs=bool(calls) and all(c.split(".")[0] in ("log", "logger", "logging", "_log", "print") for c in calls),
        )
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            if isinstance(t, ast.Name):
                self._assigned(t.id, node.value, node)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if isinstance(node.target, ast.Name) and node.value is not None:
            self._assigned(node.target.id, node.value, node)
        self.generic_visit(node)

    def _assigned(self, name: str, value: ast.AST, node: ast.AST) -> None:
        const = value.value if isinstance(value, ast.Constant) else None
        self.add("assign", node, name, value=_text(value) if isinstance(value, (ast.Constant, ast.Name)) else "", preview=_text(value)[:80], constant=isinstance(value, ast.Constant), at_module=not self.scope, mutable=isinstance(value, (ast.List, ast.Dict, ast.Set)))
        if isinstance(const, str):
            self.paths[name] = const, "string_literal"
        elif isinstance(value, ast.Call) and dotted(value.func).rpartition(".")[2] in ("Path", "PurePath", "join"):
            parts = [self._path(a)[0] for a in value.args]
            if parts and all(parts):
                self.paths[name] = "/".join(parts), "path_constructor"
        elif isinstance(value, ast.Name) and value.id in self.paths:
            self.paths[name] = self.paths[value.id]
        elif isinstance(value, ast.Call) and isinstance(value.func, ast.Attribute) and value.func.attr == "with_suffix" and dotted(value.func.value) in self.paths:
            self.paths[name] = self.paths[dotted(value.func.value)]
        if name == "__all__" and isinstance(value, (ast.List, ast.Tuple)):
            for e in value.elts:
                if isinstance(e, ast.Constant):
                    self.add("exported", e, str(e.value))

    def _path(self, node: ast.AST | None) -> tuple[str, str]:
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return node.value, "unknown"
        if isinstance(node, ast.Name):
            if node.id in self.paths:
                return self.paths[node.id]
            if self.functions and node.id in [a.arg for a in self.functions[-1].args.args]:
                return "", "function_parameter"
        if isinstance(node, ast.Call) and dotted(node.func).rpartition(".")[2] in ("Path", "PurePath", "join", "with_suffix", "str"):
            inner = [self._path(a)[0] for a in node.args]
            if isinstance(node.func, ast.Attribute) and node.func.attr == "with_suffix":
                return self._path(node.func.value)
            return ("/".join(inner), "path_constructor") if inner and all(inner) else ("", "unknown")
        return "", "unknown"

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Store) and node.id not in self.quiet:
            self.add("bound", node, node.id)
        self.generic_visit(node)

    def visit_Compare(self, node: ast.Compare) -> None:
        if isinstance(node.left, ast.Constant) and isinstance(node.left.value, str) and any(isinstance(op, (ast.In, ast.NotIn)) and dotted(c) in ("os.environ", "environ") for op, c in zip(node.ops, node.comparators, strict=True)):
            self.add("env_asked", node, node.left.value)
        self.generic_visit(node)

    def visit_If(self, node: ast.If) -> None:
        if _text(node.test) == "__name__ == '__main__'" and not self.scope:
            self.add("main", node, "__main__")
        for n in ast.walk(node.test):
            if isinstance(n, ast.Name):
                self.add("tested", node, n.id)
        self.generic_visit(node)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        if dotted(node.value) in ("os.environ", "environ") and isinstance(node.slice, ast.Constant):
            self.add("env", node, str(node.slice.value), guarded=False)
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        callee, first = dotted(node.func), node.args[0] if node.args else None
        kwargs = [k.arg for k in node.keywords if k.arg]
        built = isinstance(first, ast.JoinedStr) or isinstance(first, ast.BinOp) and isinstance(first.op, (ast.Add, ast.Mod)) or isinstance(first, ast.Call) and dotted(first.func).endswith("format")
        true = ",".join(k.arg for k in node.keywords if k.arg and isinstance(k.value, ast.Constant) and k.value.value is True)
        text = _text(first)
        self.add(
            "call", node, callee, kwargs, first=text[:80], sql=built and len(text) >= 20 and bool(_SQL.search(text)), held_out=bool(_HELD_OUT.search(text)), n_args=len(node.args), built=built, true=true, loops=self.loops, awaited=getattr(node, "_awaited", False), in_function=bool(self.functions), at_module=not self.scope,
            in_async=bool(self.functions) and isinstance(self.functions[-1], ast.AsyncFunctionDef), negative=isinstance(first, ast.UnaryOp) and isinstance(first.op, ast.USub) or any(isinstance(k.value, ast.UnaryOp) and k.arg == "periods" for k in node.keywords),
        )
        if callee in ("os.getenv", "getenv", "os.environ.get", "environ.get") and isinstance(first, ast.Constant):
            self.add("env", node, str(first.value), guarded=True)
        if callee in ("import_module", "importlib.import_module", "__import__") and isinstance(first, ast.Constant):
            self.add("import", node, str(first.value), kind="dynamic", bound="", asname="", in_function=bool(self.functions))
        self._write(node, callee, first)
        last = callee.rpartition(".")[2]
        if last in ("read_text", "read_bytes") and isinstance(node.func, ast.Attribute):
            self.add("read", node, self._path(node.func.value)[0])
        elif callee in ("open", "io.open") and (len(node.args) < 2 or isinstance(node.args[1], ast.Constant) and not set(str(node.args[1].value)) & set("wax+")):
            self.add("read", node, self._path(first)[0])
        self.generic_visit(node)

    def _write(self, node: ast.Call, callee: str, first: ast.AST | None) -> None:
        last = callee.rpartition(".")[2]
        target, kind = None, ""
        if last in ("write_text", "write_bytes", "save") and isinstance(node.func, ast.Attribute):
            target, kind = node.func.value, last
        elif last == "open":
            of = first if callee in ("open", "io.open", "codecs.open") else getattr(node.func, "value", None)
            rest = node.args[1:] if callee in ("open", "io.open", "codecs.open") else node.args
            mode = next((k.value for k in node.keywords if k.arg == "mode"), rest[0] if rest else None)
            if isinstance(mode, ast.Constant) and isinstance(mode.value, str) and set(mode.value) & set("wax+"):
                target, kind = of, "open"
        elif callee == "json.dump" and len(node.args) > 1:
            target, kind = node.args[1], "json.dump"
        elif callee in ("os.replace", "os.rename") and len(node.args) > 1:
            target, kind = node.args[1], callee
        if kind:
            path, how = self._path(target)
            self.add("write", node, path, kind=kind, provenance=how, hint=_text(target)[:80])


def extract(path: str, text: str) -> list[tuple]:
    def failed(kind: str, e: Exception) -> list[tuple]:
        line = getattr(e, "lineno", None) or 1
        return [(path, kind, line, line, str(e)[:200], "", {}, [])]

    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEP))
    try:
        tree = ast.parse(text.removeprefix("\ufeff"))
    except (RecursionError, MemoryError) as e:
        return failed("too_deep", e)
    except (SyntaxError, ValueError) as e:
        return failed("syntax_error", e)
    try:
        return _rows(path, tree)
    except (RecursionError, MemoryError) as e:  # this file only
        return failed("too_deep", e)


def _rows(path: str, tree: ast.Module) -> list[tuple]:
    v = _Visitor(path)
    v.visit(tree)
    v.add("depth", None, str(v.deepest), line=v.deepest_line)
    for s in tree.body:
        if isinstance(s, ast.Expr) and isinstance(s.value, ast.Call):
            v.add("side_effect", s, dotted(s.value.func))
    test = "test_" in path or "_test.py" in path
    for rule in [*local_rules.RULES, *(local_rules.TEST_RULES if test else [])]:
        for check, line, detail, severity, impact in rule(tree, path):
            v.rows.append((path, "hit", line, line, check, "", {"detail": detail, "severity": severity, "impact": impact}, []))
    if test:
        for f, own, others in local_rules.simulated(tree):
            v.add("simulated", f, f.name, others, own=",".join(own))
    for first, last in local_rules.string_lines(tree):
        v.rows.append((path, "string", first, last, "", "", {}, []))
    return v.rows


def facts(files: DataFrame) -> DataFrame:
    """The facts of all Python files."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, text in zip(b["path"], b["text"], strict=True):
                rows += extract(path, text)
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    ship(files.sparkSession)
    return files.where(F.col("text").isNotNull() & F.coalesce(paths.language(F.col("path")) == "python", F.lit(False))).select("path", "text").mapInPandas(run, SCHEMA)
