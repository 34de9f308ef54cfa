"""Keyword search over symbols: stored postings, synonyms, the sum of all match terms, text searches, session boosts, concepts of three weights.

Symbols are (id, project, path, kind, name, summary, content, refs, exported, start_line).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shared import scope, small
from tessera.functions.text import BOUNDARY, LEAST, tokens
from tessera.operators.search import B, K1, cooccurrence

#: Words of programming that stand for one another.
CONCEPTS = [
    ["auth", "login", "authenticate", "signin", "sign_in", "logon"],
    ["delete", "remove", "destroy", "drop", "erase", "unlink"],
    ["create", "add", "insert", "new", "make", "build", "generate"],
    ["update", "edit", "modify", "patch", "change", "alter"],
    ["get", "fetch", "retrieve", "load", "find", "query", "read", "obtain"],
    ["list", "index", "browse", "enumerate", "all"],
    ["validate", "check", "verify", "assert", "ensure", "test"],
    ["send", "emit", "dispatch", "publish", "notify", "broadcast"],
    ["receive", "listen", "subscribe", "consume", "handle"],
    ["parse", "decode", "deserialize", "unmarshal", "extract"],
    ["format", "encode", "serialize", "marshal", "render", "stringify"],
    ["open", "start", "begin", "init", "initialize", "setup", "launch"],
    ["close", "stop", "end", "finish", "shutdown", "teardown", "cleanup"],
    ["show", "display", "render", "present", "visible"],
    ["hide", "conceal", "invisible", "collapse"],
    ["enable", "activate", "on", "allow"],
    ["disable", "deactivate", "off", "deny", "block"],
    ["save", "store", "persist", "write", "commit", "flush"],
    ["cache", "memoize", "buffer", "memo"],
    ["config", "configuration", "settings", "options", "preferences", "prefs"],
    ["error", "exception", "fault", "failure"],
    ["log", "logger", "logging", "trace", "debug"],
    ["user", "account", "profile", "member"],
    ["permission", "role", "access", "privilege", "acl"],
    ["token", "jwt", "session", "cookie", "credential"],
    ["route", "path", "endpoint", "url", "api"],
    ["middleware", "interceptor", "filter", "guard", "hook"],
    ["component", "widget", "element", "view"],
    ["store", "state", "reducer", "slice"],
    ["modal", "dialog", "popup", "overlay"],
    ["toast", "notification", "alert", "snackbar", "message"],
]
#: Points of a symbol's kind; parts of paths that count less; how many postings' hits count, and what the best of them is worth.
KIND_POINTS = {"composable": 15, "component": 12, "function": 10, "class": 8, "interface": 6, "type": 5, "method": 3, "store": 12, "api": 10}
LOW_PATHS = ["test", "tests", "__test__", "spec", "mock", "fixture", "example"]
HITS, BEST = 200, 30.0
#: Directories that postings are dealt into by their term's hash.
DEALT = 64


def words_of(text: str) -> list[str]:
    """The tokens of a query, as ``tokens`` makes them of a column."""
    return [p.lower() for w in re.findall(r"\w+", text) for p in re.split(BOUNDARY, w) if len(p) >= LEAST]


def expand_query(query: str) -> tuple[set[str], set[str]]:
    """The words of a query, whole and split, and their synonyms that it lacks."""
    said = set()
    for word in re.findall(r"\w+", query):
        said.add(word.lower())
        said |= {p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\d|\b)|[a-z]+|\d+", word)}
    more = {s for group in CONCEPTS for w in said if w in group for s in group}
    return said, more - said


# ---------------------------------------------------------------- stored postings


def save_postings(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Postings (term, ``key``, tf, dl) in directories by term, sorted in them, and one row of corpus figures; texts are tokenized once."""
    t = docs.select(F.col(key), F.explode(F.array(tokens(F.col(text)))).alias("t"))
    posts = t.select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    posts = posts.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(DEALT)).cast("int"))
    posts.repartition("part", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    t.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl")).write.mode("overwrite").parquet(f"{path}/corpus")


def load_postings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/corpus")


def search_postings(spark: SparkSession, path: str, key: str, query: list[str], k: int = 20) -> DataFrame:
    """The ``k`` best (key, score) by BM25, reading only the directories and row groups of the query's terms."""
    posts, corpus = load_postings(spark, path)
    terms = sorted(set(query))
    if not terms:
        return posts.select(key, F.lit(0.0).alias("score")).limit(0)
    asked = spark.createDataFrame([(t, query.count(t)) for t in terms], "term string, times int")
    parts = [r[0] for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(DEALT)).cast("int")).distinct().collect()]
    hits = posts.where(F.col("part").isin(parts) & F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    c = corpus.first()
    n, avgdl = (c["n"], c["avgdl"] or 1.0) if c else (0, 1.0)
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    s = hits.join(F.broadcast(df), "term").join(F.broadcast(asked), "term").groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))
    return s.orderBy(F.desc("score"), key).limit(k)


# ---------------------------------------------------------------- scores


def _any_in(c: Column, words) -> Column:
    out = F.lit(False)
    for w in sorted(words):
        out = out | c.contains(w)
    return out


def fuzzy_share(name: Column, query: str) -> Column:
    """Edit similarity, 0 where the lengths differ by over half of the longer."""
    low, q = F.lower(name), query.lower()
    longer = F.greatest(F.length(low), F.lit(len(q)))
    near = 1 - F.levenshtein(low, F.lit(q)) / longer
    return F.when(low == q, 1.0).when((F.length(low) == 0) | F.lit(not q) | (F.abs(F.length(low) - len(q)) > longer * 0.5), 0.0).otherwise(near)


def keyword_search(symbols: DataFrame, query: str, hits: DataFrame | None = None, k: int = 20, kind: str | None = None, project: str | None = None, boost: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` best (id, project, path, name, kind, score, match), ties by id, then project. A symbol is a project's: equal ids of two are two.

    ``hits`` (project, id, score; without a project they are all projects') are the postings' best for the query and its
    synonyms; with them only hits and name matches are candidates. Points: hits up to 30,
    name 10, equal 20, synonym in the name 5, edit similarity from 0.6 up to
    15, summary 5 or 3, content 1 without a hit; a matched symbol gains for
    its kind, its callers, exports and the session's paths and loses for
    tests.
    """
    low_query = query.lower()
    words, (said, more) = low_query.split(), expand_query(query)
    s = symbols.dropDuplicates(["project", "id"])
    if kind:
        s = s.where(F.lower("kind") == kind.lower())
    if project:
        s = s.where(F.lower("project").contains(project.lower()))
    name, summary = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("summary", F.lit("")))
    named = _any_in(name, words)
    if hits is None:
        s = s.withColumn("_hit", F.lit(0.0))
    else:
        best = hits.agg(F.max("score")).first()[0] or 0.0
        key = [*scope(s, hits), "id"]
        s = s.join(small(hits.select(*key, (F.col("score") / F.lit(float(best or 1.0)) * BEST).alias("_hit"))), key, "left")
        if best:
            s = s.where(F.col("_hit").isNotNull() | named | _any_in(name, more) | (name == low_query))
        s = s.withColumn("_hit", F.coalesce("_hit", F.lit(0.0)))
    fuzzy = fuzzy_share(F.coalesce("name", F.lit("")), query)
    told, meant = _any_in(summary, words), _any_in(summary, more)
    terms = [
        ("bm25", F.col("_hit") > 0, F.col("_hit")), ("name", named, F.lit(10.0)), ("", name == low_query, F.lit(20.0)), ("synonym", _any_in(name, more), F.lit(5.0)),
        ("fuzzy", fuzzy >= 0.6, fuzzy * 15.0), ("summary", told, F.lit(5.0)), ("summary_synonym", ~told & meant, F.lit(3.0)),
        ("content", (F.col("_hit") == 0) & _any_in(F.lower(F.coalesce("content", F.lit(""))), said | more), F.lit(1.0)),
    ]
    base = sum((F.when(when, points).otherwise(0.0) for _, when, points in terms), F.lit(0.0))
    match = F.array_join(F.filter(F.array(*[F.when(when, F.lit(label)) for label, when, _ in terms if label]), lambda x: x.isNotNull()), ", ")
    kinds = F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_POINTS.items() for x in kv])[F.col("kind")], F.lit(0))
    path = F.lower(F.coalesce("path", F.lit("")))
    extra = kinds + F.least(F.coalesce("refs", F.lit(0)) * 0.5, F.lit(10.0)) - F.when(_any_in(path, LOW_PATHS), 5).otherwise(0)
    extra = extra + F.when(F.coalesce("exported", F.lit(False)), 3).otherwise(0) + F.when(F.col("path").isin(list(boost)), 8).otherwise(0)
    s = s.withColumn("_base", base).where("_base > 0").select("id", "project", "path", "name", "kind", F.round(F.col("_base") + extra, 1).alias("score"), match.alias("match"))
    return s.orderBy(F.desc("score"), "id", "project").limit(k)


# ---------------------------------------------------------------- text searches

#: Markers of work to do, comments and string literals.
MARKER = r"(?i)(?:#|//|/\*|\*)\s*(TODO|FIXME|XXX|HACK|NOTE|BUG)[\s:]+([^\n\r]*)"
COMMENTS = [r"#\s*([^\n]*)", r"//\s*([^\n]*)", r"(/\*[\s\S]*?\*/)"]
STRINGS = [r'"([^"\\]*(?:\\.[^"\\]*)*)"', r"'([^'\\]*(?:\\.[^'\\]*)*)'", r"`([^`]*)`"]


def text_search(symbols: DataFrame, query: str, what: str = "all", most: int | None = 5) -> DataFrame:
    """(id, project, path, name, type, text) of markers, comments, strings -- or, where there is none, of the text itself -- that hold ``query``, case aside.

    ``what`` is all, todo, comment, string or content, the text itself whatever else it holds; at most ``most`` matches a symbol, None for all.
    """
    c, q = F.coalesce("content", F.lit("")), query.lower()
    holds = lambda x: F.contains(F.lower(x), F.lit(q))
    found = []

    def add(label: str, pattern: str, group: int, tidy=lambda x: x):
        all_ = F.filter(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), holds)
        found.append(F.transform(all_, lambda x: F.struct(F.lit(label).alias("type"), F.substring(F.trim(tidy(x)), 1, 100).alias("text"))))

    if what in ("all", "todo"):
        add("todo", f"({MARKER})".replace("((?i)", "(?i)("), 1)
    if what in ("all", "comment"):
        for p in COMMENTS:
            add("comment", p, 1, lambda x: F.replace(F.replace(x, F.lit("/*"), F.lit("")), F.lit("*/"), F.lit("")))
    if what in ("all", "string"):
        for p in STRINGS:
            add("string", p, 1)
    hits = F.concat(*found) if found else None
    if what in ("all", "content"):
        at = F.locate(q, F.lower(c))
        around = F.substring(F.trim(F.replace(F.substring(c, F.greatest(at - 30, F.lit(1)), at - F.greatest(at - 30, F.lit(1)) + len(q) + 30), F.lit("\n"), F.lit(" "))), 1, 100)
        general = F.when(at > 0, F.array(F.struct(F.lit("content").alias("type"), around.alias("text")))).otherwise(F.array().cast("array<struct<type:string,text:string>>"))
        hits = F.when(F.size(hits) > 0, hits).otherwise(general) if what == "all" else general
    if most is not None:
        hits = F.slice(hits, 1, most)
    return symbols.select("id", "project", "path", "name", F.inline(hits))


# ---------------------------------------------------------------- concepts

#: Weight of terms that share a file, an edge, a caller.
FILE_WEIGHT, EDGE_WEIGHT, CALLER_WEIGHT = 1.0, 2.0, 1.5


def concept_pairs(terms: DataFrame, edges: DataFrame, callers: DataFrame) -> DataFrame:
    """(x, y, c): how much terms of symbols belong together.

    ``terms`` is (project, id, path, term), each once; ``edges`` (project,
    source, target); ``callers`` (project, symbol_id, caller_id); the project
    is part of the key where all have it. Terms of a file of two symbols or
    more, of what one caller calls, and of the two ends of an edge.
    """
    own = scope(terms, edges, callers)
    several = lambda rows, g: rows.groupBy(*own, g).agg(F.count_distinct("id").alias("n")).where("n > 1").select(*own, g)
    group = lambda c: F.struct(*own, c).alias("group")
    files = terms.join(several(terms, "path"), [*own, "path"]).select(group("path"), "term").distinct()
    called = callers.join(terms.select(*own, F.col("id").alias("symbol_id"), "term"), [*own, "symbol_id"]).select(*own, "caller_id", F.col("symbol_id").alias("id"), "term")
    shared = called.join(several(called, "caller_id"), [*own, "caller_id"]).select(group("caller_id"), "term").distinct()
    side = lambda end, term: terms.select(*own, F.col("id").alias(end), F.col("term").alias(term))
    ends = edges.select(*own, "source", "target").join(side("source", "x"), [*own, "source"]).join(side("target", "y"), [*own, "target"]).where("x <> y")
    one = ends.groupBy("x", "y").agg((F.count("*") * EDGE_WEIGHT).alias("c"))
    both = one.union(one.select(F.col("y").alias("x"), F.col("x").alias("y"), "c"))
    all_ = cooccurrence(files, "group", FILE_WEIGHT).union(cooccurrence(shared, "group", CALLER_WEIGHT)).union(both)
    return all_.groupBy("x", "y").agg(F.sum("c").alias("c"))


# ---------------------------------------------------------------- relevance of references


def score_references(references: DataFrame, target_path: str, target_project: str, recent: DataFrame, hot: DataFrame) -> DataFrame:
    """References (path, project, confidence) with their relevance: confidence, changed lately (``recent``) or often (``hot``, both (path)), tests, project, folder."""
    r = references
    for name, rows in (("_recent", recent), ("_hot", hot)):
        key = [*scope(r, rows), "path"]
        r = r.join(small(rows.select(*key).distinct().withColumn(name, F.lit(True))), key, "left")
    folder = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    own, there, low = folder(F.lit(target_path)), folder(F.col("path")), F.lower("path")
    score = F.when(F.col("confidence") == "high", 10).when(F.coalesce("confidence", F.lit("medium")) == "medium", 5).otherwise(1)
    score = score + F.when(F.col("_recent"), 8).when(F.col("_hot"), 4).otherwise(0) - F.when(low.contains("test") | low.contains("spec"), 5).otherwise(0)
    score = score + F.when(F.col("project") == target_project, 3).otherwise(0)
    nested = (own != "") & (there != "") & (own.startswith(there) | there.startswith(own))
    score = score + F.when(own == there, 5).when(nested, 2).otherwise(0)
    return r.withColumn("relevance", score.cast("double")).drop("_recent", "_hot").orderBy(F.desc("relevance"), "path")
