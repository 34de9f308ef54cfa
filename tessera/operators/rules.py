"""Rules of a project: denied files and lines by glob, layers that may not import each other.

Rules are few literal rows, so they become one expression over a file's path and are tested in place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.quality import numbered_lines


def glob_regex(pattern: str) -> str:
    """A whole-path pattern: without ``**`` a star crosses folders, with it a single star stays in one."""
    deep, out = "**" in pattern, ""
    for piece in re.split(r"(\*\*/|\*\*|\*|\?)", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*" if deep else ".*", "?": "[^/]" if deep else "."}.get(piece, re.escape(piece))
    return rf"(?s)\A{out}\z"


def matches(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def _hits(tests: list[Column]) -> Column:
    return F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("rule")


def denied_files(files: DataFrame, denied: dict[str, str], path: str = "path") -> DataFrame:
    """(path, rule): files whose path a rule's glob denies."""
    return files.select(path, _hits([F.when(matches(F.col(path), g), F.lit(n)) for n, g in denied.items()]))


def denied_lines(files: DataFrame, denied: dict[str, tuple[str, str]], path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, rule): lines that hold a rule's pattern in files of its glob. A pattern that does not compile is skipped."""
    good = {}
    for name, (pattern, where) in denied.items():
        try:
            re.compile(pattern)
            good[name] = (pattern, where)
        except re.error:
            continue
    inside = F.lit(False)
    for _, where in good.values():
        inside = inside | matches(F.col(path), where)
    l = numbered_lines(files.where(inside & F.col(text).isNotNull()), path, text)  # noqa: E741
    return l.select(path, "line", _hits([F.when(matches(F.col(path), w) & F.col("content").rlike(p), F.lit(n)) for n, (p, w) in good.items()] or [F.lit(None).cast("string")]))


def pass_rate(violations: DataFrame, rules: int) -> DataFrame:
    """(rules, broken, rate) of one project."""
    g = violations.agg(F.countDistinct("rule").alias("broken"))
    return g.select(F.lit(rules).alias("rules"), "broken", F.round(1 - F.col("broken") / rules, 6).alias("rate"))


def layer_of(path: Column, layers: dict[str, list[str]]) -> Column:
    """The first layer one of whose globs fits; null if none does."""
    out = F.lit(None).cast("string")
    for name, globs in reversed(layers.items()):
        fits = F.lit(False)
        for g in globs:
            fits = fits | matches(path, g)
        out = F.when(fits, name).otherwise(out)
    return out


def layer_breaches(imports: DataFrame, layers: dict[str, list[str]], may: dict[str, list[str]], may_not: dict[str, list[str]]) -> DataFrame:
    """(from_file, to_file, line, from_layer, to_layer, kind) of imports (from_file, to_file, line) between layers; a denial beats a permission."""
    e = imports.withColumn("from_layer", layer_of(F.col("from_file"), layers)).withColumn("to_layer", layer_of(F.col("to_file"), layers))
    kind = F.lit(None).cast("string")
    for name in layers:
        here = F.col("from_layer") == name
        kind = F.when(here & F.col("to_layer").isin(may_not.get(name, [])), "cannot_import").when(here & F.lit(bool(may.get(name))) & ~F.col("to_layer").isin(may.get(name, [])), "not_in_can_import").otherwise(kind)
    return e.where("from_layer <> to_layer").withColumn("kind", kind).where("kind is not null").select("from_file", "to_file", "line", "from_layer", "to_layer", "kind")
