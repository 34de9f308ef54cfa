"""Before an edit: who calls a symbol and where, how risky a change is, paths from entry points, and what a file or symbol is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.shared import scope, written
from tessera.operators.graph import simple_paths

#: Names, beginnings of names and kinds that a call graph starts at.
ENTRY_NAMES = ["main", "app", "index", "__init__", "setup", "configure", "handle", "route", "endpoint", "cli", "do_GET", "do_POST", "do_PUT", "do_DELETE"]
ENTRY_STARTS = ["test_", "handle_", "on_", "route_"]
ENTRY_KINDS = ["api", "route", "component"]
#: What a kind of change means for those who call.
CHANGES = {
    "rename": "All call sites must update the name.",
    "delete": "All call sites will break.",
    "signature_change": "Call sites may need parameter updates.",
    "add_param": "Call sites may need to pass the new argument.",
    "modify": "Internal logic change only.",
}


def bare(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def is_entry(name: Column, kind: Column, exported: Column, refs: Column) -> Column:
    """Whether a symbol is where calls begin: by name, by kind, or exported and called by nobody."""
    out = bare(name).isin(ENTRY_NAMES) | kind.isin(ENTRY_KINDS) | (F.coalesce(exported, F.lit(False)) & (F.coalesce(refs, F.lit(0)) == 0))
    for start in ENTRY_STARTS:
        out = out | bare(name).startswith(start)
    return out


def find_symbol(symbols: DataFrame, asked: str, project: str | None = None, most: int = 5) -> DataFrame:
    """The symbols (id, name, refs) that ``asked`` means: that id, else names, last parts of names and names case aside; most called first."""
    exact = symbols.where(F.col("id") == asked)
    named = symbols.where((F.col("name") == asked) | (bare(F.col("name")) == asked) | (F.lower("name") == asked.lower()))
    if project:
        named = named.where(F.lower("project").startswith(project.lower()))
    both = exact.withColumn("_rank", F.lit(0)).union(named.withColumn("_rank", F.lit(1)))
    best = both.agg(F.min("_rank").alias("_best"))
    return both.join(F.broadcast(best), F.col("_rank") == F.col("_best")).drop("_best", "_rank").orderBy(F.desc("refs"), "id").limit(most)


def trace_up(callers: DataFrame, symbols: DataFrame, targets: DataFrame, depth: int = 8) -> DataFrame:
    """(target, path, entry): paths from entry points down to each target (id) along ``callers`` (symbol_id, caller_id); of several projects, give ids that tell them apart.

    A path ends at the first entry point above the target or at a symbol that
    nobody calls; entries are written first, so a level is one join.
    """
    entry = written(symbols.select("id", is_entry(F.col("name"), F.col("kind"), F.col("exported"), F.col("refs")).alias("entry")), "entries")
    up = callers.select(F.col("symbol_id").alias("source"), F.col("caller_id").alias("target")).distinct()
    stops = entry.where("entry").select(F.col("id").alias("source"))
    start = targets.select("id").distinct()
    # nothing is followed beyond an entry point, but a target that is one is left by its callers
    open_ = up.join(stops, "source", "left_anti").union(up.join(stops, "source", "left_semi").join(start.select(F.col("id").alias("source")), "source", "left_semi"))
    paths = simple_paths(open_, start, depth, None)
    last = F.element_at("path", -1)
    ended = paths.where(F.size("path") > 1).withColumn("id", last).join(entry, "id", "left")
    ended = ended.where(F.col("entry") | (F.col("ended") == "leaf"))
    return ended.select(F.col("start").alias("target"), F.reverse("path").alias("path"), F.coalesce("entry", F.lit(False)).alias("entry")).distinct()


def call_sites(callers: DataFrame, symbols: DataFrame, contents: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, caller, project, file, line, code): the first line of each caller that names the target; callers in the target's own file are left out.

    ``contents`` is (project, id, content), ``symbols`` (project, id, path,
    name, start_line), ``targets`` (project, id), ``callers`` (project,
    symbol_id, caller_id). Where all have a project, it is part of the key.
    """
    own = scope(callers, symbols, contents, targets)
    t = targets.select(*own, F.col("id").alias("target")).join(symbols.select(*own, F.col("id").alias("target"), F.col("name").alias("_name"), F.col("path").alias("_path")), [*own, "target"])
    c = callers.select(*own, F.col("symbol_id").alias("target"), F.col("caller_id").alias("id")).distinct().join(t, [*own, "target"])
    c = c.join(symbols.select("id", "project", "path", "start_line"), [*own, "id"]).where("path <> _path").join(contents.select(*own, "id", "content"), [*own, "id"], "left")
    lines = F.split(F.coalesce("content", F.lit("")), "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, bare(F.col("_name")))), True)
    line = F.when(at > 0, F.col("start_line") + at.cast("int") - 1).otherwise(0)
    code = F.when(at > 0, F.substring(F.trim(F.element_at(lines, F.greatest(at, F.lit(1)).cast("int"))), 1, 120)).otherwise("")
    return c.select("target", F.col("id").alias("caller"), "project", F.col("path").alias("file"), line.cast("int").alias("line"), code.alias("code"))


def edit_risk(sites: DataFrame, targets: DataFrame, change: str = "modify") -> DataFrame:
    """(target, sites, projects, risk, meaning), after the project if ``targets`` have one, of changing each target: safe, low, moderate or high by its call sites; deletions and renames are never low."""
    own = scope(sites, targets)
    n = sites.groupBy(*own, "target").agg(F.count("*").alias("sites"), F.count_distinct("project").alias("projects"))
    t = targets.select(*own, F.col("id").alias("target")).join(n, [*own, "target"], "left").fillna(0, ["sites", "projects"])
    risk = F.when(F.col("sites") == 0, "safe").when((F.col("sites") <= 3) & (F.col("projects") <= 1), "low").when(F.col("sites") <= 10, "moderate").otherwise("high")
    if change in ("delete", "rename"):
        risk = F.when(F.col("sites") == 0, "safe").when(F.col("sites") > 3, "high").otherwise("moderate")
    return t.select(*own, "target", "sites", "projects", risk.alias("risk"), F.lit(CHANGES.get(change, "Unknown change type.")).alias("meaning"))


# ---------------------------------------------------------------- files and symbols


def file_infos(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, path, symbols, kinds, imports, summary): a row of every file; ``edges`` are scanned ones."""
    kind = F.struct("start_line", F.col("kind").alias("kind"), F.col("name").alias("name"))
    s = symbols.groupBy("project", "path").agg(
        F.count("*").alias("symbols"), F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.min_by("summary", F.struct(~F.col("kind").isin("component", "class"), "start_line")).alias("summary"), F.array_sort(F.collect_list(kind)).alias("outline"),
    )
    i = edges.where("type = 'imports'").groupBy("project", F.substring_index("source", ":", 1).alias("path")).agg(F.array_sort(F.collect_set("target")).alias("imports"))
    return s.join(i, ["project", "path"], "left").withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))


def related_files(callers: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, other, links), after the project where both have one: files whose symbols call one another, either way."""
    own = scope(callers, symbols)
    paths = symbols.select(*own, "id", "path")
    j = callers.join(paths.withColumnsRenamed({"id": "symbol_id", "path": "a"}), [*own, "symbol_id"]).join(paths.withColumnsRenamed({"id": "caller_id", "path": "b"}), [*own, "caller_id"]).where("a <> b")
    both = j.select(*own, F.col("a").alias("path"), F.col("b").alias("other")).union(j.select(*own, F.col("b").alias("path"), F.col("a").alias("other")))
    return both.groupBy(*own, "path", "other").agg(F.count("*").alias("links"))


def file_texts(infos: DataFrame) -> DataFrame:
    """(project, path, text): a file's summary, imports and symbols as text."""
    line = lambda o: F.concat(F.lit("- `"), o["kind"], F.lit("` **"), o["name"], F.lit("** (L"), o["start_line"].cast("string"), F.lit(")"))
    part = lambda title, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(rows, "\n")))
    imports = F.transform(F.slice("imports", 1, 20), lambda i: F.concat(F.lit("- "), i))
    return infos.select("project", "path", F.concat_ws("\n\n", F.concat(F.lit("# File: "), "path"), "summary", part("Imports", imports), part("Symbols", F.transform("outline", line))).alias("text"))


def project_texts(infos: DataFrame, most: int = 100) -> DataFrame:
    """(project, files, text, tokens): an outline of every project: its files by folder, the first ``most`` named; four characters count as a token."""
    row = F.struct("path", F.concat(F.lit("- `"), "path", F.lit("`: "), F.coalesce("summary", F.lit(""))).alias("line"))
    # ranked first: no project's whole list of files comes into one row
    named = infos.withColumn("_at", F.row_number().over(W.partitionBy("project").orderBy("path"))).where(F.col("_at") <= most)
    rows = named.groupBy("project").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    p = infos.groupBy("project").agg(F.count("*").alias("files")).join(rows, "project")
    text = F.concat(F.lit("# Project: "), "project", F.lit("\n\n## File Map\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return p.select("project", "files", text.alias("text")).withColumn("tokens", (F.length("text") / 4).cast("int"))
