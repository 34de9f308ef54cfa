"""How projects are written: naming, patterns, imports, files, errors; which modules tests reach; which steps of a plan came too early.

Everything is one grouped count per question, of all projects at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Styles of names, the first that the whole name fits.
STYLES = [
    ("UPPER_SNAKE", r"^[A-Z][A-Z0-9_]+$"),
    ("PascalCase", r"^[A-Z][a-zA-Z0-9]+$"),
    ("camelCase", r"^(?=.*[A-Z])[a-z][a-zA-Z0-9]+$"),
    ("snake_case", r"^(?=.*_)[a-z][a-z0-9_]+$"),
    ("kebab-case", r"-"),
    ("lowercase", r"^[a-z]+$"),
]
#: What functions do about errors, by words that must all be in their summary or first 500 characters.
ERROR_WORDS = {
    "try_except": ["try", "except"], "raise_exception": ["raise"], "uses_logging": ["logg"], "error_dict_return": ["return {", "error"], "uses_assert": ["assert"],
}
#: Words of modules that matter most, folders of those, folders that matter somewhat.
IMPORTANT_WORDS, IMPORTANT_FOLDERS, HELPING_FOLDERS = ["auth", "pay", "order", "user", "api", "core"], ["api", "core", "services", "auth"], ["utils", "helpers", "lib"]


def style(name: Column) -> Column:
    """The style of a bare name; null for names of one character and of no style."""
    out = F.lit(None).cast("string")
    for label, pattern in reversed(STYLES):
        out = F.when(name.rlike(pattern), label).otherwise(out)
    return F.when(F.length(name) >= 2, out)


def _bare(c: str) -> Column:
    return F.element_at(F.split(c, r"\."), -1)


def naming(symbols: DataFrame) -> DataFrame:
    """(project, kind, style, n, share, rank) of symbols' last names; names that begin with two underscores are left out. Rank 1 is the rule, ties by name."""
    s = symbols.where("name <> '' and not startswith(name, '__')").select("project", "kind", style(_bare("name")).alias("style")).where("style is not null")
    g = s.groupBy("project", "kind", "style").agg(F.count("*").alias("n"))
    by = W.partitionBy("project", "kind")
    return g.select("*", F.round(F.col("n") / F.sum("n").over(by) * 100, 1).alias("share"), F.row_number().over(by.orderBy(F.desc("n"), "style")).alias("rank"))


def returned(symbols: DataFrame) -> DataFrame:
    """(project, returns, n): types that functions and methods return, without their parameters."""
    s = symbols.where("kind in ('function', 'method') and returns <> ''").select("project", F.substring_index(F.trim("returns"), "[", 1).alias("returns"))
    return s.groupBy("project", "returns").agg(F.count("*").alias("n"))


def parameter_counts(symbols: DataFrame) -> DataFrame:
    """(project, params, n) of functions and methods that take any."""
    s = symbols.where("kind in ('function', 'method') and size(params) > 0").select("project", F.size("params").alias("params"))
    return s.groupBy("project", "params").agg(F.count("*").alias("n"))


def imported(edges: DataFrame) -> DataFrame:
    """(project, what, name, n): modules, without leading dots, and names that imports ask for; private names are left out."""
    i = edges.where("type = 'imports'")
    modules = i.where("target <> ''").select("project", F.lit("module").alias("what"), F.regexp_replace("target", r"^\.+/?", "").alias("name"))
    names = i.select("project", F.lit("name").alias("what"), F.explode("names").alias("name")).where("name <> '' and not startswith(name, '_')")
    return modules.union(names).groupBy("project", "what", "name").agg(F.count("*").alias("n"))


def files(symbols: DataFrame) -> DataFrame:
    """(project, path, symbols, lines, pattern): what each file is made of."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    g = symbols.where("path <> ''").groupBy("project", "path").agg(
        F.count("*").alias("symbols"), F.sum(F.col("end_line") - F.col("start_line")).alias("lines"), *[of(k).alias(f"_{k}") for k in ("class", "method", "function", "component")]
    )
    pattern = F.when((F.col("_class") == 1) & (F.col("_method") > 0), "single_class_with_methods").when((F.col("_function") > 0) & (F.col("_class") == 0), "functions_only")
    pattern = pattern.when(F.col("_component") > 0, "component_file").when(F.col("_class") > 1, "multi_class").otherwise("other")
    return g.select("project", "path", "symbols", "lines", pattern.alias("pattern"))


def organisation(symbols: DataFrame) -> DataFrame:
    """(project, files, symbols_per_file, lines_per_file, patterns): patterns is a map of counts."""
    f = files(symbols)
    kinds = f.groupBy("project", "pattern").agg(F.count("*").alias("n")).groupBy("project").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pattern", "n")))).alias("patterns"))
    g = f.groupBy("project").agg(F.count("*").alias("files"), F.round(F.avg("symbols"), 1).alias("symbols_per_file"), F.round(F.avg("lines"), 1).alias("lines_per_file"))
    return g.join(kinds, "project")


def error_handling(symbols: DataFrame) -> DataFrame:
    """(project, functions, and a count for each way) over functions and methods with summary and content."""
    text = F.lower(F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.substring(F.coalesce("content", F.lit("")), 1, 500)))
    s = symbols.where("kind in ('function', 'method')").select("project", text.alias("text"))

    def all_in(words: list[str]) -> Column:
        out = F.lit(True)
        for w in words:
            out = out & F.col("text").contains(w)
        return out

    return s.groupBy("project").agg(F.count("*").alias("functions"), *[F.count_if(all_in(words)).alias(name) for name, words in ERROR_WORDS.items()])


# ---------------------------------------------------------------- modules and their tests


def importance(path: Column, functions: Column, classes: Column) -> Column:
    """high, medium or low, by what a module is called, where it lies and how much it offers."""
    parts, name = F.split(path, "/"), F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))
    named = F.lit(False)
    for w in IMPORTANT_WORDS:
        named = named | name.contains(w)
    lies = lambda folders: F.arrays_overlap(parts, F.array(*map(F.lit, folders)))
    return F.when(named | lies(IMPORTANT_FOLDERS), "high").when((functions > 5) | (classes > 2) | lies(HELPING_FOLDERS), "medium").otherwise("low")


def untested(symbols: DataFrame, tested: DataFrame) -> DataFrame:
    """(project, path, functions, classes, importance) of modules that no test is paired with; ``tested`` is (project, path)."""
    own = symbols.where("kind in ('function', 'class') and not startswith(name, '_')")
    g = own.groupBy("project", "path").agg(F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"))
    g = g.join(tested.select("project", "path").distinct(), ["project", "path"], "left_anti")
    return g.withColumn("importance", importance(F.col("path"), F.col("functions"), F.col("classes")))


def coverage_rate(symbols: DataFrame, tested: DataFrame) -> DataFrame:
    """(project, modules, covered, rate): modules that offer something, and those that a test is paired with."""
    all_ = symbols.where("kind in ('function', 'class') and not startswith(name, '_')").select("project", "path").distinct()
    j = all_.join(tested.select("project", "path", F.lit(1).alias("_t")).distinct(), ["project", "path"], "left")
    g = j.groupBy("project").agg(F.count("*").alias("modules"), F.count("_t").alias("covered"))
    return g.withColumn("rate", F.round(F.col("covered") / F.col("modules") * 100, 6))


# ---------------------------------------------------------------- plans of tasks


def early_steps(plan: DataFrame, calls: DataFrame) -> DataFrame:
    """(task, seq, step, gate) of calls that came before a gate of their task's plan, by the first gate that was open.

    ``plan`` is (task, step, place, tool, gate boolean), ``calls`` (task, seq,
    tool); a call is the first step of its tool that is not done yet: the k-th
    call of a tool is the k-th step with it. Calls of tools that a plan does
    not name are never early.
    """
    nth = lambda by, order: F.row_number().over(W.partitionBy(*by).orderBy(order))
    steps = plan.withColumn("_k", nth(["task", "tool"], "place"))
    done = calls.withColumn("_k", nth(["task", "tool"], "seq")).join(steps, ["task", "tool", "_k"]).select("task", "seq", "step", "place", "gate")
    gates = plan.where("gate").select("task", F.col("step").alias("_gate"), F.col("place").alias("_at"))
    passed = done.where("gate").select("task", F.col("step").alias("_gate"), F.col("seq").alias("_passed"))
    open_ = gates.join(passed, ["task", "_gate"], "left")
    early = done.join(open_, "task").where("_at < place and (_passed is null or _passed > seq)")
    return early.groupBy("task", "seq", "step").agg(F.min_by("_gate", "_at").alias("gate"))
