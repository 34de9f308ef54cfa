"""API contracts: declared types opened to the paths of their leaves, and what a caller expects against what a handler gives.

A round opens every type that is not a leaf by one step: alternatives, items
of a list, values of a record, fields of a declared type with its type
arguments put in. Types that come back inside themselves are leaves, so the
rounds end. Names meet declarations in one equi-join a round. Joins merge:
names take many times their files' size in memory, by which a join would send
them whole to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import written

#: Plain types, which nothing is declared for.
PLAIN = ["string", "number", "boolean", "null", "any", "never", "object", "array", "function"]


def outside(text: Column, at: str) -> Column:
    """The parts of a type between separators that no bracket encloses, trimmed."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def step(s, c):
        depth = s["depth"] + F.when(c.isin("[", "<", "(", "{"), 1).when(c.isin("]", ">", ")", "}"), -1).otherwise(0)
        cut = (c == at) & (depth == 0)
        return F.struct(depth.alias("depth"), F.when(cut, "").otherwise(F.concat(s["part"], c)).alias("part"), F.when(cut, F.concat(s["parts"], F.array(F.trim(s["part"])))).otherwise(s["parts"]).alias("parts"))

    return F.aggregate(F.split(text, ""), start, step, lambda s: F.concat(s["parts"], F.array(F.trim(s["part"]))))


def substituted(kind: Column, params: Column, args: Column) -> Column:
    """A type with its parameters replaced, all at once; parameters without an argument are any."""
    mark = lambda i: F.concat(F.lit("\x01"), i.cast("string"), F.lit("\x02"))
    pairs = F.transform(params, lambda p, i: F.struct(p.alias("p"), i.alias("i"), F.coalesce(F.get(args, i), F.lit("any")).alias("a")))
    out = F.aggregate(pairs, kind, lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"\b"), x["p"], F.lit(r"\b")), mark(x["i"])))
    return F.aggregate(pairs, out, lambda t, x: F.replace(t, mark(x["i"]), x["a"]))


def leaves(roots: DataFrame, fields: DataFrame, params: DataFrame) -> DataFrame:
    """(project, root, path, type, optional) of all leaves below ``roots`` (project, root: a type).

    ``fields`` are (project, model, field, type, optional), bases included;
    ``params`` (project, model, params). A path names fields by ``.name``,
    list items by ``[]``, record values by ``{}``. A leaf is optional if
    anything on its way is, or null is one of its alternatives. An
    undeclared name is a leaf, and a type inside itself is ``@`` and its name.
    """
    fields = written(fields.where("field is not null").join(params.hint("merge"), ["project", "model"], "left").select("project", "model", "field", F.col("type").alias("kind"), F.col("optional").alias("opt"), F.coalesce("params", F.array().cast("array<string>")).alias("params")), "fields")
    declared = fields.select("project", "model").distinct().withColumn("known", F.lit(True))
    live = written(roots.select("project", "root").distinct().select("project", "root", F.lit("").alias("path"), F.col("root").alias("type"), F.lit(False).alias("optional"), F.array().cast("array<string>").alias("seen")), "types")
    done = None
    cols = ["project", "root", "path", "type", "optional"]
    while True:
        parts = F.filter(outside(F.col("type"), "|"), lambda p: p != "")
        one = live.withColumn("parts", parts).withColumn("optional", F.col("optional") | F.array_contains("parts", "null"))
        one = one.withColumn("type", F.explode(F.when(F.size("parts") == 0, F.array(F.lit("any"))).when(F.array_contains("parts", "null") & (F.size("parts") > 1), F.array_except("parts", F.array(F.lit("null")))).otherwise(F.col("parts")))).drop("parts")
        t = F.col("type")
        head = F.regexp_extract(t, r"(?s)^([\w.]+)\s*(?:[\[<](.*)[\]>])?$", 1)
        inner = F.regexp_extract(t, r"(?s)^([\w.]+)\s*[\[<](.*)[\]>]$", 2)
        listed = t.endswith("[]")
        record = (head == "Record") & ~listed & (inner != "")
        one = one.withColumn("args", F.when(inner != "", outside(inner, ",")).otherwise(F.array().cast("array<string>"))).withColumn("head", F.when(listed | record, "").otherwise(head))
        wrapped = F.regexp_replace(F.regexp_replace(t, r"\[\]$", ""), r"(?s)^\((.*)\)$", "$1")
        open_ = one.where(listed | record).select("project", "root", F.concat("path", F.when(listed, "[]").otherwise("{}")).alias("path"), F.when(listed, wrapped).otherwise(F.get("args", F.lit(1))).alias("type"), "optional", "seen")
        named = one.where(~(listed | record)).join(declared.withColumnRenamed("model", "head").hint("merge"), ["project", "head"], "left")
        again = F.array_contains("seen", t)
        leaf = named.where(F.col("known").isNull() | again).select("project", "root", "path", F.when(again, F.concat(F.lit("@"), t)).otherwise(t).alias("type"), "optional")
        into = named.where(F.col("known").isNotNull() & ~again).join(fields.withColumnRenamed("model", "head").hint("merge"), ["project", "head"])
        into = into.select("project", "root", F.concat("path", F.lit("."), "field").alias("path"), substituted(F.col("kind"), F.col("params"), F.col("args")).alias("type"), (F.col("optional") | F.coalesce("opt", F.lit(False))).alias("optional"), F.concat("seen", F.array(t)).alias("seen"))
        leaf = written(leaf, "leaves")
        done = leaf if done is None else done.unionByName(leaf)
        live = written(open_.unionByName(into), "types")
        if live.isEmpty():
            break
    return done.groupBy(*cols[:4]).agg(F.min("optional").alias("optional"))


def compared(contracts: DataFrame, given: DataFrame, expected: DataFrame) -> DataFrame:
    """(contract, path, issue, severity) of ``contracts`` (contract, project, root, caller_project, caller_root).

    ``given`` are the leaves of what handlers give, ``expected`` of what
    callers expect. any fits everything; a path that several types may stand
    at fits if the sets are equal, or the caller's holds the handler's.
    """
    side = lambda rows, own, c: rows.groupBy("project", "root", "path").agg(F.array_sort(F.collect_set("type")).alias(f"{c}_types"), F.max("optional").alias(f"{c}_opt")).withColumnsRenamed(own)
    g = contracts.select("contract", "project", "root").join(side(given, {}, "g").hint("merge"), ["project", "root"]).select("contract", "path", "g_types", "g_opt")
    e = contracts.select("contract", "caller_project", "caller_root").join(side(expected, {"project": "caller_project", "root": "caller_root"}, "e").hint("merge"), ["caller_project", "caller_root"]).select("contract", "path", "e_types", "e_opt")
    # a path below something that the other side leaves open is no lack
    loose = lambda rows, c: rows.where(F.array_contains(f"{c}_types", "any") | F.array_contains(f"{c}_types", "object")).select("contract", F.col("path").alias("above"))
    g, e = written(g, "given"), written(e, "expected")
    j = g.join(e.hint("merge"), ["contract", "path"], "full_outer")

    ups = F.filter(F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substring(F.col("path"), F.lit(1), i)), lambda u: u != F.col("path"))
    above = lambda rows: rows.select("contract", F.explode(ups).alias("above")).distinct()

    def covered(rows: DataFrame, own: DataFrame, other: tuple[DataFrame, str], c: str) -> DataFrame:
        """Without rows below what the other side leaves open, and without open ones that the other side says more of."""
        hit = rows.select("contract", "path", F.explode(ups).alias("above")).join(loose(other[0], other[1]).hint("merge"), ["contract", "above"], "left_semi").select("contract", "path").distinct()
        more = loose(own, c).join(above(other[0]).hint("merge"), ["contract", "above"], "left_semi").withColumnRenamed("above", "path")
        return rows.join(hit.hint("merge"), ["contract", "path"], "left_anti").join(more.hint("merge"), ["contract", "path"], "left_anti")

    both = j.where("g_types is not null and e_types is not null")
    fits = F.array_contains("g_types", "any") | F.array_contains("e_types", "any") | (F.size(F.array_except("g_types", "e_types")) == 0)
    tell = lambda rows, issue, severity: rows.select("contract", "path", F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))
    out = tell(both.where(~fits), "type_mismatch", "error")
    out = out.union(tell(both.where(fits & F.col("g_opt") & ~F.col("e_opt")), "optionality_mismatch", "warning"))
    out = out.union(tell(covered(j.where("g_types is null"), e, (g, "g"), "e").where("not e_opt"), "missing_in_handler", "error"))
    return out.union(tell(covered(j.where("e_types is null"), g, (e, "e"), "g"), "missing_in_caller", "info"))
