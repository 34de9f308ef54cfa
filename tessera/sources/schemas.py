"""Schemas of declared types: fields of Python classes and TypeScript interfaces, with types in one canonical spelling."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.arrow import batches
from tessera.sources.code import blank, block_ends

SCHEMA = "project string, path string, model string, model_kind string, bases array<string>, params array<string>, field string, type string, optional boolean"
ARROW = pa.schema(
    [("project", pa.string()), ("path", pa.string()), ("model", pa.string()), ("model_kind", pa.string()), ("bases", pa.list_(pa.string())), ("params", pa.list_(pa.string())), ("field", pa.string()), ("type", pa.string()), ("optional", pa.bool_())]
)

#: Canonical spellings of plain types.
PYTHON_TYPES = {
    "str": "string", "int": "number", "float": "number", "bool": "boolean", "None": "null", "NoneType": "null", "dict": "object", "list": "array", "tuple": "array", "set": "array", "Any": "any", "bytes": "string",
}
TYPESCRIPT_TYPES = {
    "string": "string", "number": "number", "boolean": "boolean", "null": "null", "undefined": "null", "void": "null", "any": "any", "unknown": "any", "never": "never", "object": "object", "Record": "object",
}
SEQUENCES = {"list", "List", "set", "Set", "frozenset", "FrozenSet", "Array", "ReadonlyArray"}


def split_outside(text: str, at: str) -> list[str]:
    """Parts between separators that no bracket encloses."""
    depth, parts = 0, [""]
    for c in text:
        depth += (c in "[<({") - (c in "]>)}")
        if c == at and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts]


def canonical(spelled: str, language: str) -> str:
    """One spelling of a type for both languages: string, number, boolean, null, any, object, ``T[]``, ``Record<K, V>``, function, unions."""
    t, plain = spelled.strip(), PYTHON_TYPES if language == "python" else TYPESCRIPT_TYPES
    if not t:
        return "any"
    if len(parts := split_outside(t, "|")) > 1:
        return " | ".join(canonical(p, language) for p in parts if p)
    if language != "python" and t.endswith("[]"):
        return canonical(t[:-2].strip("()"), language) + "[]"
    m = re.fullmatch(r"([\w.]+)\s*[\[<](.*)[\]>]", t, re.S)
    if not m:
        return plain.get(t, t)
    head, inner = m[1].rpartition(".")[2], split_outside(m[2], ",")
    if head in SEQUENCES:
        return canonical(m[2], language) + "[]"
    if head in ("dict", "Dict", "Record"):
        return f"Record<{canonical(inner[0], language)}, {canonical(inner[1], language)}>" if len(inner) == 2 else "object"
    if language != "python":
        return t
    if head == "Optional":
        return canonical(m[2], language) + " | null"
    if head == "Union":
        some = [canonical(p, language) for p in inner if p not in ("None", "NoneType")]
        return " | ".join((some or ["any"]) + ["null"] * any(p in ("None", "NoneType") for p in inner))
    if head in ("tuple", "Tuple"):
        return canonical(inner[0], language) + "[]" if inner[1:] == ["..."] else "array"
    return {"Annotated": lambda: canonical(inner[0], language), "Literal": lambda: " | ".join(inner), "Callable": lambda: "function"}.get(head, lambda: t)()


def _nullable(canonical_type: str) -> bool:
    return "null" in split_outside(canonical_type, "|")


def _python_models(text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    for node in ast.walk(tree):
        if not isinstance(node, ast.ClassDef):
            continue
        bases = [ast.unparse(b).split("[")[0].rpartition(".")[2] for b in node.bases]
        marks = {ast.unparse(d).split("(")[0].rpartition(".")[2] for d in node.decorator_list}
        kind = "pydantic" if "BaseModel" in bases else "typeddict" if "TypedDict" in bases else "dataclass" if "dataclass" in marks else "class"
        fields = []
        for item in node.body:
            if isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name):
                alias = None
                if isinstance(item.value, ast.Call) and ast.unparse(item.value.func).rpartition(".")[2] == "Field":
                    alias = next((k.value.value for k in item.value.keywords if k.arg in ("alias", "serialization_alias") and isinstance(k.value, ast.Constant) and isinstance(k.value.value, str)), None)
                t = canonical(ast.unparse(item.annotation), "python")
                fields.append((alias or item.target.id, t, _nullable(t)))
        params = [ast.unparse(p) for b in node.bases if isinstance(b, ast.Subscript) and ast.unparse(b.value).rpartition(".")[2] in ("Generic", "Protocol") for p in (b.slice.elts if isinstance(b.slice, ast.Tuple) else [b.slice])]
        yield node.name, kind, bases, params + [p.name for p in node.type_params], fields


FIELD = re.compile(r"(?:readonly\s+)?['\"]?(\w+)['\"]?(\?)?\s*:\s*(.+)", re.S)


def _typescript_fields(body: str) -> list[tuple[str, str, bool]]:
    fields = []
    for part in split_outside(body.replace("=>", "\v\v").replace("\n", ";"), ";"):
        for piece in split_outside(part, ","):
            if m := FIELD.match(piece.strip().replace("\v\v", "=>")):
                t = "function" if "=>" in m[3] else canonical(m[3], "typescript")
                fields.append((m[1], t, bool(m[2]) or _nullable(t)))
    return fields


#: Utility types over another declared type.
UTILITY = re.compile(r"^(?:export\s+)?type\s+(\w+)\s*=\s*(Pick|Omit|Partial|Required|Readonly)<\s*(\w+)\s*(?:,\s*([^>]*))?>", re.M)


def _typescript_models(text: str) -> Iterator[tuple]:
    blanked = blank(text, "typescript")
    ends, known = block_ends(blanked), {}
    for m in re.finditer(r"^(?:export\s+)?(?:interface\s+(\w+)(?:<([^>{]*)>)?(?:\s+extends\s+([^{]+))?|type\s+(\w+)(?:<([^>=]*)>)?\s*=\s*((?:\w+\s*&\s*)*))\s*\{", blanked, re.M):
        name, start = m[1] or m[4], m.end()
        bases = [b.split("<")[0].strip() for b in re.split(r"[,&]", m[3] or m[6] or "") if b.strip()]
        after = re.match(r"\s*&\s*(\w+)", blanked[ends[start - 1] + 1 :]) if m[4] else None
        params = [p.split()[0] for p in split_outside(m[2] or m[5] or "", ",") if p]
        known[name] = ("interface" if m[1] else "type", bases + ([after[1]] if after else []), params, _typescript_fields(re.sub(r"/\*.*?\*/|//[^\n]*", "", text[start : ends[start - 1]], flags=re.S)))
    for m in UTILITY.finditer(text):
        keys = set(re.findall(r"['\"](\w+)['\"]", m[4] or ""))
        of = known.get(m[3], ("type", [], [], []))[3]
        kept = [f for f in of if {"Pick": f[0] in keys, "Omit": f[0] not in keys}.get(m[2], True)]
        known[m[1]] = ("type", [], [], [(n, t, {"Partial": True, "Required": False}.get(m[2], o)) for n, t, o in kept])
    for name, (kind, bases, params, fields) in known.items():
        yield name, kind, bases, params, fields


def models(files: DataFrame, project: str = "project", path: str = "path", text: str = "text") -> DataFrame:
    """(project, path, model, model_kind, bases, params, field, type, optional) of every declared type; one without fields has one row with a null field."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            for pr, pt, tx in zip(*(c.to_pylist() for c in part.columns)):
                ext = (pt or "").rpartition(".")[2]
                found = _python_models(tx or "") if ext == "py" else _typescript_models(tx or "") if ext in ("ts", "tsx") else ()
                for model, kind, bases, params, fields in found:
                    yield from (dict(zip(ARROW.names, (pr, pt, model, kind, bases, params, *f))) for f in fields or [(None, None, None)])

    return files.select(F.col(project).alias("project"), F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(lambda parts: batches(rows(parts), ARROW), SCHEMA)


def inherited(found: DataFrame, depth: int = 3) -> DataFrame:
    """(project, model, field, type, optional) with the fields of bases up to ``depth`` levels; the nearest declaration of a field wins.

    Each level is one join on (project, model), which merges; ``found`` should be written before.
    """
    own = found.select("project", "model", "field", "type", "optional", F.lit(0).alias("level")).where("field is not null")
    up = found.select("project", "model", F.explode("bases").alias("base")).distinct()
    fields, links, out = own.drop("level"), up, own
    for level in range(1, depth + 1):
        step = links.join(fields.withColumnRenamed("model", "base").hint("merge"), ["project", "base"])
        out = out.unionByName(step.select("project", "model", "field", "type", "optional", F.lit(level).alias("level")))
        links = links.join(up.select("project", F.col("model").alias("base"), F.col("base").alias("next")).hint("merge"), ["project", "base"]).select("project", "model", F.col("next").alias("base")).distinct()
    g = out.groupBy("project", "model", "field").agg(F.min_by(F.struct("type", "optional"), F.struct("level", "type")).alias("x"))
    return g.select("project", "model", "field", "x.type", "x.optional")


def drift(fields: DataFrame) -> DataFrame:
    """(model, project, first_project, field, issue, severity): models of one name in several projects, each against the first project in code point order.

    Rows are fields, so a much used model name spreads over its fields and
    projects. ``fields`` are read several times: write them before. Joins
    merge: names take many times their files' size in memory.
    """
    owners = fields.select("model", "project").distinct()
    first = owners.groupBy("model").agg(F.min("project").alias("first_project"), F.count("*").alias("n")).where("n > 1").drop("n")
    others = owners.join(first.hint("merge"), "model").where("project <> first_project")
    base = fields.join(first.hint("merge"), "model").where("project = first_project").select("model", "field", F.col("type").alias("p_type"), F.col("optional").alias("p_opt"))
    left = others.join(base.hint("merge"), "model")
    right = fields.join(others.hint("merge"), ["model", "project"]).select("model", "project", "first_project", "field", F.col("type").alias("c_type"), F.col("optional").alias("c_opt"))
    j = left.join(right, ["model", "project", "first_project", "field"], "full_outer")
    issue = (
        F.when(F.col("c_type").isNull(), "missing_in_consumer").when(F.col("p_type").isNull(), "missing_in_producer")
        .when(F.col("p_type") != F.col("c_type"), "type_mismatch").when(F.col("p_opt") != F.col("c_opt"), "optionality_mismatch")
    )
    severity = F.when(F.col("issue") == "missing_in_consumer", "info").when(F.col("issue") == "optionality_mismatch", "warning").otherwise("error")
    return j.withColumn("issue", issue).where("issue is not null").select("model", "project", "first_project", "field", "issue", severity.alias("severity"))

