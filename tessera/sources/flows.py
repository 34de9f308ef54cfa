"""What flows where inside Python functions: parameters, assignments, arguments and results, as rows."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.sources.arrow import batches

#: kind is param (a: its name, b: its type), move (a flows to b) or pass (a flows to argument ``pos``, or ``word``, of b's call at ``site``).
SCHEMA = "project string, fn string, kind string, a string, b string, site string, pos int, word string"
ARROW = pa.schema([(n, pa.string() if t == "string" else pa.int32()) for n, t in (c.split() for c in SCHEMA.split(", "))])
RESULT = "return"
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else None


def _function(fn: str, node, method: bool) -> Iterator[dict]:
    """Rows of one function; its own nested functions are left out, a call's value is named by where the call stands."""
    a = node.args
    listed = [*a.posonlyargs, *a.args][method:]
    for k, p in enumerate([*listed, *a.kwonlyargs]):
        yield {"kind": "param", "a": p.arg, "b": ast.unparse(p.annotation) if p.annotation else None, "pos": k if k < len(listed) else None}
    rows = []

    def values(e: ast.AST | None) -> list[str]:
        """Variables whose value is in that of ``e``; truth values carry nothing."""
        out, stack = [], [e]
        while stack:
            x = stack.pop()
            if isinstance(x, ast.Name):
                out.append(x.id)
            elif isinstance(x, ast.Call):
                site = f"@{x.lineno}:{x.col_offset}"
                callee = _dotted(x.func)
                for k, arg in enumerate(x.args):
                    rows.extend({"kind": "pass", "a": v, "b": callee, "site": site, "pos": k} for v in values(arg))
                for w in x.keywords:
                    rows.extend({"kind": "pass", "a": v, "b": callee, "site": site, "word": w.arg} for v in values(w.value))
                if not x.args and not x.keywords:
                    rows.append({"kind": "pass", "a": None, "b": callee, "site": site})
                out.append(site)
            elif not isinstance(x, (ast.Compare, ast.Lambda, type(None))):
                stack += [c for c in ast.iter_child_nodes(x) if isinstance(c, (ast.expr, ast.keyword, ast.comprehension, ast.FormattedValue))]
        return out

    def names(t: ast.AST) -> list[str]:
        if isinstance(t, (ast.Attribute, ast.Subscript, ast.Starred)):
            return names(t.value)
        return [t.id] if isinstance(t, ast.Name) else [n for e in getattr(t, "elts", []) for n in names(e)]

    def move(e: ast.AST | None, to: list[str]) -> None:
        found = values(e)
        rows.extend({"kind": "move", "a": v, "b": t} for v in found for t in to)

    stack = list(node.body)
    while stack:
        s = stack.pop()
        if isinstance(s, (*_FUNCTIONS, ast.ClassDef)):
            continue
        if isinstance(s, ast.Assign):
            move(s.value, [n for t in s.targets for n in names(t)])
        elif isinstance(s, (ast.AnnAssign, ast.AugAssign)):
            move(s.value, names(s.target))
        elif isinstance(s, ast.Return):
            move(s.value, [RESULT])
        elif isinstance(s, (ast.For, ast.AsyncFor)):
            move(s.iter, names(s.target))
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for item in s.items:
                move(item.context_expr, names(item.optional_vars) if item.optional_vars else [])
        else:
            for child in ast.iter_child_nodes(s):
                if isinstance(child, ast.expr):
                    move(child, [RESULT] if isinstance(child, (ast.Yield, ast.YieldFrom)) else [])
        stack += [c for c in ast.iter_child_nodes(s) if isinstance(c, (ast.stmt, ast.ExceptHandler, ast.match_case))]
    yield from rows


def facts_of(project: str | None, path: str, text: str) -> Iterator[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    own = [(n, f"{path}:function:{n.name}", False) for n in tree.body if isinstance(n, _FUNCTIONS)]
    for c in (c for c in ast.walk(tree) if isinstance(c, ast.ClassDef)):
        for m in c.body:
            if isinstance(m, _FUNCTIONS):
                still = any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in m.decorator_list)
                own.append((m, f"{path}:method:{c.name}.{m.name}", not still))
    for node, fn, method in own:
        for row in _function(fn, node, method):
            yield {"project": project, "fn": fn, "site": None, "pos": None, "word": None} | row


def facts(files: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA`` for every Python file of ``files`` (project, path, text); others have none. Write them once."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            for pr, pt, tx in zip(*(c.to_pylist() for c in part.columns)):
                if pt is not None and tx is not None and pt.endswith(".py"):
                    yield from facts_of(pr, pt, tx)

    return files.select("project", "path", "text").mapInArrow(lambda parts: batches(rows(parts), ARROW), SCHEMA)
