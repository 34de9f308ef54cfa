"""``python -m tessera.cli COMMAND ROOT``: operators over a source tree, one JSON object a row on standard output.

A thin layer: it reads the tree, scans it once into the shared folder, and
calls the operators of this library. ``--save FOLDER`` writes the rows as
Parquet instead, which is the way for results of any size.
"""

from __future__ import annotations

import argparse
import json
import re
import subprocess
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shared import written
from tessera.operators import graph, keyword, preview, project, requests, resolution, rules, security
from tessera.sources import catalog, code, histories, manifests, metrics, rulebook

EXTENSIONS = ["py", "ts", "tsx", "js", "jsx", "mjs", "vue", "go", "java", "rs", "json", "toml", "txt", "lock", "mod", "sum", "xml", "gradle", "yaml", "yml", "tf", "md"]
COMMANDS: dict[str, tuple[Callable, str, list[tuple]]] = {}


@dataclass
class Tree:
    """The files of one root and what is scanned from them, each computed when first asked for."""

    spark: SparkSession
    root: str
    args: argparse.Namespace

    def __post_init__(self):
        self.project = self.root.rstrip("/").rsplit("/", 1)[-1]
        self._known: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._known:
            self._known[name] = written(make(), name)
        return self._known[name]

    @property
    def files(self) -> DataFrame:
        return self.once("files", lambda: catalog.read_tree(self.spark, self.root, EXTENSIONS).withColumn("project", F.lit(self.project)))

    @property
    def rows(self) -> DataFrame:
        return self.once("rows", lambda: code.scan(self.files))

    @property
    def symbols(self) -> DataFrame:
        return code.symbols(self.rows)

    @property
    def edges(self) -> DataFrame:
        return code.edges(self.rows)

    @property
    def callers(self) -> DataFrame:
        return self.once("callers", lambda: resolution.reverse_of_files(self.symbols, self.edges, self.files.select("project", "path", "text")))

    @property
    def counted(self) -> DataFrame:
        """Symbols with their content and the number of their callers."""
        n = resolution.counts(self.callers).select("project", F.col("symbol_id").alias("id"), "refs")
        c = resolution.contents(self.symbols, self.files.select("project", "path", "text")).select("project", "id", "content")
        return self.symbols.join(n, ["project", "id"], "left").join(c, ["project", "id"], "left").fillna(0, ["refs"]).withColumn("exported", F.lit(False))


def command(about: str, *options: tuple):
    def add(f):
        COMMANDS[f.__name__.replace("_", "-")] = (f, about, list(options))
        return f

    return add


def _one(t: Tree, found: dict) -> DataFrame:
    return t.spark.createDataFrame([(json.dumps(found),)], "result string")


@command("symbols of all files")
def scan(t: Tree) -> DataFrame:
    return t.symbols


@command("relations between symbols and names")
def edges(t: Tree) -> DataFrame:
    return t.edges


@command("counts of files, symbols, relations")
def status(t: Tree) -> DataFrame:
    kinds = t.symbols.groupBy("kind").agg(F.count("*").alias("n")).select(F.concat(F.lit("symbols: "), "kind").alias("what"), "n")
    types = t.edges.groupBy("type").agg(F.count("*").alias("n")).select(F.concat(F.lit("relations: "), "type").alias("what"), "n")
    return t.files.agg(F.count("*").alias("n")).select(F.lit("files").alias("what"), "n").union(kinds).union(types).orderBy("what")


@command("keyword search", ("query",), ("--kind",), ("--most",))
def search(t: Tree) -> DataFrame:
    return keyword.keyword_search(t.counted, t.args.query, k=int(t.args.most or 20), kind=t.args.kind)


@command("search in comments, strings and markers", ("query",), ("--what",))
def fulltext(t: Tree) -> DataFrame:
    return keyword.text_search(t.counted, t.args.query, t.args.what or "all")


@command("who refers to a symbol", ("symbol",))
def references(t: Tree) -> DataFrame:
    found = preview.find_symbol(t.counted, t.args.symbol).select("project", F.col("id").alias("symbol_id"))
    return t.callers.join(F.broadcast(found), ["project", "symbol_id"])


@command("what depends on a symbol", ("symbol",), ("--depth",))
def impact(t: Tree) -> DataFrame:
    found = preview.find_symbol(t.counted, t.args.symbol, most=1).first()
    pairs = t.callers.select(F.col("symbol_id").alias("target"), F.col("caller_id").alias("source"))
    return graph.impact(pairs, found["id"] if found else t.args.symbol, int(t.args.depth or 3))


@command("paths from entry points to a symbol", ("symbol",))
def trace(t: Tree) -> DataFrame:
    return preview.trace_up(t.callers, t.counted, preview.find_symbol(t.counted, t.args.symbol, most=3).select("id"))


@command("call sites of a symbol", ("symbol",))
def call_sites(t: Tree) -> DataFrame:
    s = t.once("counted", lambda: t.counted)
    return preview.call_sites(t.callers, s, s, preview.find_symbol(s, t.args.symbol).select("project", "id"))


@command("risk of a change of a symbol", ("symbol",), ("--change",))
def edit_preview(t: Tree) -> DataFrame:
    s = t.once("counted", lambda: t.counted)
    targets = preview.find_symbol(s, t.args.symbol).select("project", "id")
    return preview.edit_risk(preview.call_sites(t.callers, s, s, targets), targets, t.args.change or "modify")


@command("symbols that nothing speaks of")
def dead(t: Tree) -> DataFrame:
    return resolution.dead_symbols(t.symbols, t.edges, t.files.select("project", "path", "text"), t.callers)


@command("an outline of the project as text")
def outline(t: Tree) -> DataFrame:
    return preview.project_texts(preview.file_infos(t.symbols, t.edges))


@command("the outline alone, short", ("--most",))
def brief(t: Tree) -> DataFrame:
    return preview.project_texts(preview.file_infos(t.symbols, t.edges), int(t.args.most or 20))


@command("files as text: summary, imports, symbols", ("--path",))
def context(t: Tree) -> DataFrame:
    texts = preview.file_texts(preview.file_infos(t.symbols, t.edges))
    return texts.where(F.col("path") == t.args.path) if t.args.path else texts


@command("what files hold")
def describe(t: Tree) -> DataFrame:
    return preview.file_infos(t.symbols, t.edges).drop("outline")


@command("a symbol's own lines", ("symbol",))
def content(t: Tree) -> DataFrame:
    return preview.find_symbol(t.counted, t.args.symbol).select("id", "path", "start_line", "end_line", "content")


@command("functions by complexity")
def complexity(t: Tree) -> DataFrame:
    return metrics.scored(metrics.function_metrics(t.files))


@command("secrets and risky lines")
def secrets(t: Tree) -> DataFrame:
    return security.line_findings(t.files)


@command("tainted data in sinks, with the project's own rules")
def taint(t: Tree) -> DataFrame:
    own = rulebook.Taint.of(security.R.SOURCES, security.R.SINKS, security.R.SANITIZERS, rulebook.load(t.root).get("taint"))
    return security.taint(t.once("flows", lambda: security.flows(t.files, rules=own)))


@command("issues of container and infrastructure files")
def infrastructure(t: Tree) -> DataFrame:
    return security.infrastructure(t.files)


@command("declared and pinned packages")
def deps(t: Tree) -> DataFrame:
    return manifests.inventory(manifests.packages(t.files).withColumn("project", F.lit(t.project)), "project")


@command("a bill of materials")
def sbom(t: Tree) -> DataFrame:
    return manifests.sbom(deps(t), "project")


@command("licence texts")
def licence(t: Tree) -> DataFrame:
    return t.files.select("path", project.licence_of(F.col("text")).alias("licence")).where("licence is not null")


@command("frameworks by packages and marker files")
def framework(t: Tree) -> DataFrame:
    return project.frameworks(manifests.packages(t.files).withColumn("project", F.lit(t.project)), t.files, "project")


@command("files that break the project's rules")
def check(t: Tree) -> DataFrame:
    files, lines = rulebook.denials(rulebook.load(t.root))
    out = t.spark.createDataFrame([], "path string, line int, rule string")
    if files:
        out = out.union(rules.denied_files(t.files, files).select("path", F.lit(None).cast("int"), "rule"))
    return out.union(rules.denied_lines(t.files, lines).select("path", F.col("line").cast("int"), "rule")) if lines else out


@command("imports that layers may not have")
def layers(t: Tree) -> DataFrame:
    known = resolution.imported_symbols(t.symbols, t.edges)
    path = resolution.path_of
    e = known.select(path(F.col("source")).alias("from_file"), path(F.col("found")).alias("to_file"), F.lit(0).alias("line")).distinct()
    return rules.layer_breaches(e, *rulebook.layers(rulebook.load(t.root)))


@command("answers of interfaces that keep no form")
def answers(t: Tree) -> DataFrame:
    return requests.answers(t.files).where("issue is not null")


@command("risk of what changed since a revision", ("--base",))
def pr_risk(t: Tree) -> DataFrame:
    base = [f"{t.args.base}...HEAD"] if t.args.base else []
    if t.args.base and not re.fullmatch(r"[\w./@^~{}-]{1,256}", t.args.base):
        raise SystemExit("not a revision")
    text = subprocess.run(["git", "-C", t.root, "diff", "--no-color", *base], capture_output=True, text=True, timeout=30).stdout
    return requests.risk(t.spark.createDataFrame([(t.project, text)], "id string, text string"))


@command("files by changes", ("--log",))
def churn(t: Tree) -> DataFrame:
    """From a saved log (``git log --numstat --format=COMMIT:%H|%at|%an|%s``)."""
    from tessera.operators import history

    return history.churn(histories.log_numstat(t.spark.read.text(t.args.log, wholetext=True), "value"))


@command("all tables as line-delimited JSON", ("folder",))
def export(t: Tree) -> DataFrame:
    catalog.export({"symbols": t.symbols, "edges": t.edges, "callers": t.callers}, t.args.folder)
    return _one(t, {"written": t.args.folder})


@command("add a rule", ("category",), ("rule",), ("--glob",), ("--grep",))
def add_rule(t: Tree) -> DataFrame:
    a = t.args
    return _one(t, rulebook.add_rule(t.root, a.category, a.rule, [a.glob] if a.glob else None, [{"pattern": a.grep}] if a.grep else None))


@command("remove a rule", ("category",), ("rule",))
def remove_rule(t: Tree) -> DataFrame:
    return _one(t, rulebook.remove_rule(t.root, t.args.category, t.args.rule))


@command("add a layer", ("name",), ("globs",), ("--can",), ("--cannot",))
def add_layer(t: Tree) -> DataFrame:
    split = lambda s: s.split(",") if s else []
    return _one(t, rulebook.add_layer(t.root, t.args.name, split(t.args.globs), split(t.args.can), split(t.args.cannot)))


@command("remove a layer", ("name",))
def remove_layer(t: Tree) -> DataFrame:
    return _one(t, rulebook.remove_layer(t.root, t.args.name))


@command("add a taint source", ("pattern",), ("--language",))
def add_taint_source(t: Tree) -> DataFrame:
    return _one(t, rulebook.add_taint_source(t.root, t.args.pattern, t.args.language or "python"))


@command("add a taint sink", ("pattern",), ("--category",), ("--severity",))
def add_taint_sink(t: Tree) -> DataFrame:
    return _one(t, rulebook.add_taint_sink(t.root, t.args.pattern, t.args.category or "custom", t.args.severity or "high"))


@command("add a taint sanitizer", ("pattern",), ("--cleanses",))
def add_taint_sanitizer(t: Tree) -> DataFrame:
    return _one(t, rulebook.add_taint_sanitizer(t.root, t.args.pattern, t.args.cleanses.split(",") if t.args.cleanses else None))


@command("remove a taint rule", ("kind",), ("pattern",))
def remove_taint_rule(t: Tree) -> DataFrame:
    return _one(t, rulebook.remove_taint_rule(t.root, t.args.kind, t.args.pattern))


@command("the project's taint rules")
def list_taint_rules(t: Tree) -> DataFrame:
    return _one(t, rulebook.list_taint_rules(t.root))


@command("these commands")
def tools(t: Tree) -> DataFrame:
    return t.spark.createDataFrame([(n, about) for n, (_, about, _) in COMMANDS.items()], "command string, about string")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (_, about, options) in COMMANDS.items():
        p = sub.add_parser(name, help=about)
        p.add_argument("root")
        for option in options:
            p.add_argument(*option)
        p.add_argument("--save", help="folder that the rows are written to as Parquet")
        p.set_defaults(save=None)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    args = parser().parse_args(argv)
    spark, out = spark or SparkSession.builder.appName("tessera").getOrCreate(), out or sys.stdout
    df = COMMANDS[args.command][0](Tree(spark, args.root, args))
    if args.save:
        df.write.mode("overwrite").parquet(args.save)
    else:
        for row in df.toJSON().toLocalIterator():
            print(row, file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
