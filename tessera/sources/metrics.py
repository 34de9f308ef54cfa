"""Sizes of functions: lines, depth, parameters, branches and returns of every function of a source file."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.quality import complexity
from tessera.sources.arrow import batches
from tessera.sources.code import LANGUAGES, blank, parse

SCHEMA = "project string, path string, name string, start_line int, lines int, depth int, params int, branches int, returns int"
ARROW = pa.schema([(n, pa.string() if t == "string" else pa.int32()) for n, t in (c.split() for c in SCHEMA.split(", "))])
#: Words that branch, counted once a line each; longest function, in files with templates a longer one.
BRANCH_WORDS = ["if", "else", "for", "while", "switch", "try", "catch", "case", "match", "select"]
LONG, LONG_TEMPLATE, TEMPLATES = 80, 100, r"\.(?:vue|tsx|jsx)$"
NESTING = (ast.If, ast.For, ast.While, ast.With, ast.Try)


def _below(node: ast.AST) -> list[ast.AST]:
    """Statements, handlers and cases right below one; expressions hold none."""
    return [c for part in ("body", "orelse", "handlers", "finalbody", "cases") for c in getattr(node, part, ())]


def _python(text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    every = [tree]
    for f in every:
        every += _below(f)
        if not isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        a = f.args
        params = len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
        deepest, branches, returns, stack = 0, 0, 0, [(f, 0)]
        while stack:
            node, depth = stack.pop()
            if isinstance(node, NESTING):
                depth, branches = depth + 1, branches + 1
                deepest = max(deepest, depth)
            if isinstance(node, ast.If):  # an elif counts as a branch of its own and again below its if
                branches += sum(isinstance(n, ast.If) for n in node.orelse)
            returns += isinstance(node, ast.Return)
            stack += [(c, depth) for c in _below(node)]
        yield f.name, f.lineno, f.end_lineno - f.lineno + 1, deepest, params, branches, returns


def _braced(path: str, text: str, language: str) -> Iterator[tuple]:
    lines = blank(text, "typescript" if language == "vue" else language).split("\n")
    for s in parse(None, path, text):
        if s["row"] != "symbol" or s["kind"] not in ("function", "method", "composable", "component") or path.endswith(".vue") and s["kind"] == "component":
            continue
        body, depth, deepest = lines[s["start_line"] - 1 : s["end_line"]], 0, 0
        for brace in re.findall(r"[{}]", "\n".join(body)):
            depth = max(0, depth + (1 if brace == "{" else -1))
            deepest = max(deepest, depth)
        branches = sum(bool(re.search(rf"\b{w}\b", line)) for line in body for w in BRANCH_WORDS)
        returns = sum(len(re.findall(r"\breturn\b", line)) for line in body)
        yield s["name"], s["start_line"], len(body), deepest, len(s["params"]), branches, returns


def function_metrics(files: DataFrame, project: str = "project", path: str = "path", text: str = "text") -> DataFrame:
    """(project, path, name, start_line, lines, depth, params, branches, returns); depth of languages with braces counts the function's own."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            for pr, pt, tx in zip(*(c.to_pylist() for c in part.columns)):
                language = LANGUAGES.get((pt or "").rpartition(".")[2])
                if language and tx is not None:
                    found = _python(tx) if language == "python" else _braced(pt, tx, language)
                    yield from (dict(zip(ARROW.names, (pr, pt, *f))) for f in found)

    chosen = files.select(F.col(project).alias("project"), F.col(path).alias("path"), F.col(text).alias("text"))
    return chosen.mapInArrow(lambda parts: batches(rows(parts), ARROW), SCHEMA)


def scored(metrics: DataFrame) -> DataFrame:
    """Metrics with ``score`` and the list of ``issues``; the limit of lines depends on the file."""
    limit = F.when(F.col("path").rlike(TEMPLATES), LONG_TEMPLATE).otherwise(LONG)
    c = {n: F.col(n) for n in ("lines", "depth", "params", "branches")}
    score = F.when(limit == LONG, complexity(c["lines"], c["depth"], c["params"], c["branches"], LONG)).otherwise(complexity(c["lines"], c["depth"], c["params"], c["branches"], LONG_TEMPLATE))
    issues = F.array(
        F.when(c["lines"] > limit, "too long"), F.when(c["depth"] > 3, "too deep"), F.when(c["params"] > 5, "too many parameters"), F.when(c["branches"] > 10, "too many branches")
    )
    return metrics.withColumn("score", score).withColumn("issues", F.filter(issues, lambda x: x.isNotNull()))
