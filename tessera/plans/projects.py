"""Queries over scanned projects: every nation a Python project whose files import, export again and call one another.

A supplier is a library file, a customer a program. Programs call a helper of
their nation's first supplier, a function that the package exports again, one
that only its name tells, and one that nobody declares.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.shared import dealt, folder, written
from tessera.operators import dataflow as D
from tessera.operators import keyword as K
from tessera.operators import paths as A
from tessera.operators import preview as P2
from tessera.operators import project as J
from tessera.operators import requests as Q
from tessera.operators import resolution as R
from tessera.operators import rules as U
from tessera.operators import testmap as T
from tessera.plans.registry import query
from tessera.sources import code as P
from tessera.sources import flows as L
from tessera.sources import manifests as M
from tessera.sources.tables import load


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith(("s_", "c_", "n_")) else F.col(p) for p in parts])


def _rows(spark, sf, name):
    """Keys and nations of customers or suppliers, dealt out before they become files."""
    return dealt(load(spark, sf, name).select(f"{name[0]}_{'cust' if name == 'customer' else 'supp'}key", f"{name[0]}_nationkey"))


def project_files(spark, sf):
    """(project, path, text)"""
    nation, supplier, customer = load(spark, sf, "nation"), _rows(spark, sf, "supplier"), _rows(spark, sf, "customer")
    project = lambda c: F.concat(F.lit("p"), F.col(c)).alias("project")
    lib = _text(
        "def help", "s_suppkey", "(x):\n    return near", "s_suppkey", "(x)\n\ndef near", "s_suppkey", "(x):\n    return {'k': table", "s_suppkey", "}\n\ndef table", "s_suppkey",
        "(x):\n    return x\n\nclass Kind", "s_suppkey", ":\n    def act", "s_suppkey", "(self):\n        return self.rest", "s_suppkey", "()\n\n    def rest", "s_suppkey", "(self):\n        return 1\n",
    )
    first = supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("s_suppkey"))
    run = _text(
        "from s", "s_suppkey", " import help", "s_suppkey", "\nfrom pkg import deep", "c_nationkey", "\n\ndef run", "c_custkey", "():\n    help", "s_suppkey", "(1)\n    deep", "c_nationkey",
        "(2)\n    only", "c_nationkey", "(3)\n    nowhere", "c_custkey", "(4)\n",
    )
    path = lambda a, c, b: F.concat(F.lit(a), F.col(c), F.lit(b)).alias("path")
    out = supplier.select(project("s_nationkey"), path("lib/s", "s_suppkey", ".py"), lib.alias("text"))
    out = out.union(customer.join(first, "c_nationkey").select(project("c_nationkey"), path("app/c", "c_custkey", ".py"), run.alias("text")))
    fixed = [
        ("pkg/__init__.py", ("from .core import deep", "n_nationkey", "\n")), ("core.py", ("def deep", "n_nationkey", "(x):\n    return x\n")),
        ("misc.py", ("def only", "n_nationkey", "(x):\n    return x\n\ndef lonely", "n_nationkey", "(x):\n    return x\n")),
    ]
    for p, parts in fixed:
        out = out.union(nation.select(project("n_nationkey"), F.lit(p).alias("path"), _text(*parts).alias("text")))
    return out


def scanned(spark, sf):
    """Symbols, edges and files of the projects; the scan is written once."""
    files = project_files(spark, sf)
    rows = written(P.scan(files), "scan")
    return P.symbols(rows), P.edges(rows), files


SQL = """
WITH f AS (SELECT s_nationkey AS n, min(s_suppkey) AS s FROM supplier GROUP BY 1),
c AS (SELECT c_custkey AS k, c_nationkey AS n, s FROM customer JOIN f ON n = c_nationkey)
"""


@query(
    SQL
    + """
SELECT 'p' || n AS project, 'app/c' || k || '.py:function:run' || k AS source, t AS target, found, stage FROM (
  SELECT n, k, 'help' || s AS t, 'lib/s' || s || '.py:function:help' || s AS found, 'import' AS stage FROM c UNION ALL
  SELECT n, k, 'deep' || n, 'core.py:function:deep' || n, 're_export' FROM c UNION ALL
  SELECT n, k, 'only' || n, 'misc.py:function:only' || n, 'global' FROM c UNION ALL
  SELECT n, k, 'nowhere' || k, NULL, NULL FROM c)
UNION ALL SELECT 'p' || s_nationkey, 'lib/s' || s_suppkey || '.py:function:help' || s_suppkey, 'near' || s_suppkey, 'lib/s' || s_suppkey || '.py:function:near' || s_suppkey, 'same_file' FROM supplier
UNION ALL SELECT 'p' || s_nationkey, 'lib/s' || s_suppkey || '.py:method:Kind' || s_suppkey || '.act' || s_suppkey, 'self.rest' || s_suppkey, 'lib/s' || s_suppkey || '.py:method:Kind' || s_suppkey || '.rest' || s_suppkey, 'same_file' FROM supplier
"""
)
def resolve_calls(spark, sf):
    symbols, edges, _ = scanned(spark, sf)
    return R.resolved(symbols, edges).where("type = 'calls'").drop("type")


@query(
    SQL
    + """
SELECT 'p' || n AS project, 'app/c' || k || '.py:file:c' || k AS source, 's' || s AS module, 'help' || s AS name, 'lib/s' || s || '.py:function:help' || s AS found FROM c UNION ALL
SELECT 'p' || n, 'app/c' || k || '.py:file:c' || k, 'pkg', 'deep' || n, 'core.py:function:deep' || n FROM c UNION ALL
SELECT 'p' || n_nationkey, 'pkg/__init__.py:file:__init__', 'core', 'deep' || n_nationkey, 'core.py:function:deep' || n_nationkey FROM nation
"""
)
def resolve_imports(spark, sf):
    symbols, edges, _ = scanned(spark, sf)
    return R.imported_symbols(symbols, edges)


@query(SQL + "SELECT DISTINCT 'p' || n AS project, 'pkg' AS module, 'deep' || n AS name, 'core.py:function:deep' || n AS target, 'pkg/__init__.py' AS via FROM c")
def resolve_reexports(spark, sf):
    symbols, edges, _ = scanned(spark, sf)
    asked = edges.where("type = 'imports' and target = 'pkg'").select("project", F.col("target").alias("module"), F.explode("names").alias("name")).distinct()
    return R.by_re_export(symbols, edges, asked)


@query("""
SELECT p_brand AS project, CASE p_size % 3 WHEN 0 THEN 'GET /v1/parts/' || p_partkey WHEN 1 THEN 'POST /parts/' || p_partkey ELSE 'GET arts/' || p_partkey END AS target,
  'routes.py:api:' || CASE p_size % 3 WHEN 1 THEN 'POST' ELSE 'GET' END || ' /parts/' || p_partkey AS found FROM part
""")
def resolve_api_calls(spark, sf):
    """Routes of two methods for every part; requests with a prefix, exact ones, and ones that the route's end answers."""
    part = load(spark, sf, "part").withColumn("route", F.concat(F.lit("/parts/"), "p_partkey"))
    verbs = part.select(F.col("p_brand").alias("project"), F.explode(F.array(F.lit("GET"), F.lit("POST"))).alias("verb"), "route")
    name = F.concat("verb", F.lit(" "), "route")
    symbols = verbs.select("project", F.concat(F.lit("routes.py:api:"), name).alias("id"), F.lit("api").alias("kind"), name.alias("name"))
    asks = F.when(F.expr("p_size % 3 = 0"), F.concat(F.lit("GET /v1"), "route")).when(F.expr("p_size % 3 = 1"), F.concat(F.lit("POST "), "route")).otherwise(F.concat(F.lit("GET arts/"), "p_partkey"))
    edges = part.select(F.col("p_brand").alias("project"), asks.alias("target"), F.lit("api_calls").alias("type"))
    return R.by_request(symbols, edges)


@query(
    SQL
    + """
, lib AS (SELECT 'p' || s_nationkey AS project, s_suppkey AS s, 'lib/s' || s_suppkey || '.py' AS path, s_nationkey AS n FROM supplier)
SELECT project, path || ':function:help' || s AS symbol_id, path || ':class:Kind' || s AS caller_id FROM lib WHERE false UNION ALL
SELECT project, path || ':function:near' || s, path || ':function:help' || s FROM lib UNION ALL
SELECT project, path || ':function:table' || s, path || ':function:near' || s FROM lib UNION ALL
SELECT project, path || ':method:Kind' || s || '.rest' || s, path || ':method:Kind' || s || '.act' || s FROM lib UNION ALL
SELECT project, path || ':method:Kind' || s || '.act' || s, path || ':class:Kind' || s FROM lib UNION ALL
SELECT 'p' || n, 'lib/s' || s || '.py:function:help' || s, 'app/c' || k || '.py:function:run' || k FROM c UNION ALL
SELECT 'p' || n, 'lib/s' || s || '.py:function:help' || s, 'app/c' || k || '.py:file:c' || k FROM c UNION ALL
SELECT 'p' || n, 'core.py:function:deep' || n, 'app/c' || k || '.py:function:run' || k FROM c UNION ALL
SELECT 'p' || n, 'core.py:function:deep' || n, 'app/c' || k || '.py:file:c' || k FROM c UNION ALL
SELECT 'p' || n_nationkey, 'core.py:function:deep' || n_nationkey, 'pkg/__init__.py:file:__init__' FROM nation UNION ALL
SELECT 'p' || n, 'misc.py:function:only' || n, 'app/c' || k || '.py:function:run' || k FROM c
"""
)
def code_reverse_index(spark, sf):
    symbols, edges, files = scanned(spark, sf)
    return R.reverse_of_files(symbols, edges, files)


@query(
    SQL
    + """
SELECT 'p' || n_nationkey AS project, 'misc.py' AS path, 'function' AS kind, 'lonely' || n_nationkey AS name, 2 AS lines FROM nation UNION ALL
SELECT 'p' || n_nationkey, 'misc.py', 'function', 'only' || n_nationkey, 2 FROM nation WHERE n_nationkey NOT IN (SELECT n FROM c) UNION ALL
SELECT 'p' || c_nationkey, 'app/c' || c_custkey || '.py', 'function', 'run' || c_custkey, 5 FROM customer WHERE c_nationkey IN (SELECT n FROM c) UNION ALL
SELECT 'p' || s_nationkey, 'lib/s' || s_suppkey || '.py', 'function', 'help' || s_suppkey, 2 FROM supplier WHERE s_suppkey NOT IN (SELECT s FROM c) UNION ALL
SELECT 'p' || s_nationkey, 'lib/s' || s_suppkey || '.py', 'class', 'Kind' || s_suppkey, 6 FROM supplier WHERE s_suppkey NOT IN (SELECT s FROM c)
"""
)
def code_dead_symbols(spark, sf):
    symbols, edges, files = scanned(spark, sf)
    found = written(R.reverse_of_files(symbols, edges, files), "callers")
    return R.dead_symbols(symbols, edges, files, found).drop("id")


@query(
    SQL
    + """
SELECT 'p' || n AS project, 'misc.py:function:only' || n AS symbol_id, count(*) AS refs FROM c GROUP BY ALL UNION ALL
SELECT 'p' || n, 'lib/s' || s || '.py:function:help' || s, 2 * count(*) FROM c GROUP BY ALL UNION ALL
SELECT 'p' || n_nationkey, 'core.py:function:deep' || n_nationkey, 1 + 2 * count(k) FROM nation LEFT JOIN c ON n = n_nationkey GROUP BY ALL UNION ALL
SELECT 'p' || s_nationkey, 'lib/s' || s_suppkey || '.py:' || x || s_suppkey, 1 FROM supplier, (VALUES ('function:near'), ('function:table')) t(x) UNION ALL
SELECT 'p' || s_nationkey, 'lib/s' || s_suppkey || '.py:method:Kind' || s_suppkey || x || s_suppkey, 1 FROM supplier, (VALUES ('.act'), ('.rest')) t(x)
"""
)
def code_reference_counts(spark, sf):
    symbols, edges, files = scanned(spark, sf)
    return R.counts(R.reverse_of_files(symbols, edges, files))


def _symbols(spark, sf):
    """Parts as symbols: their names as names, their types as summaries."""
    return load(spark, sf, "part").select(
        F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_brand").alias("project"), F.concat(F.lit("src/"), "p_partkey", F.lit(".py")).alias("path"),
        F.when(F.col("p_size") % 2 == 0, "function").otherwise("class").alias("kind"), F.split("p_name", " ")[0].alias("name"), F.col("p_type").alias("summary"),
        F.lit("").alias("content"), F.col("p_size").alias("refs"), (F.col("p_size") % 5 == 0).alias("exported"), F.lit(1).alias("start_line"),
    )


SEARCHED = """
WITH s AS (SELECT 'part:' || (p_partkey // 2) AS id, p_brand AS project, 'src/' || p_partkey || '.py' AS path, lower(split_part(p_name, ' ', 1)) AS name, split_part(p_name, ' ', 1) AS shown,
  CASE p_size % 2 WHEN 0 THEN 'function' ELSE 'class' END AS kind, lower(p_type) AS summary, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_partkey // 2 ORDER BY p_partkey) = 1),
t AS (SELECT project, id, unnest([name, summary]) AS term FROM s),
p AS (SELECT project, id, term, count(*) AS tf FROM t WHERE term IN ('small', 'new', 'create') GROUP BY ALL),
h AS (SELECT project, id, round(sum(ln(((SELECT count(*) FROM s) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5)), 6) AS hit FROM p JOIN (SELECT term, count(*) AS df FROM p GROUP BY 1) USING (term) GROUP BY ALL),
m AS (SELECT s.*, coalesce(hit / (SELECT max(hit) FROM h) * 30, 0) AS hit, CASE WHEN abs(length(name) - 9) > greatest(length(name), 9) * 0.5 THEN 0 ELSE 1 - levenshtein(name, 'small new') / greatest(length(name), 9) END AS near,
  contains(name, 'small') OR contains(name, 'new') AS named, false AS syn, contains(summary, 'small') OR contains(summary, 'new') AS told FROM s LEFT JOIN h USING (project, id)),
b AS (SELECT *, hit + CASE WHEN named THEN 10 ELSE 0 END + CASE WHEN near >= 0.6 THEN near * 15 ELSE 0 END + CASE WHEN told THEN 5 ELSE 0 END AS base FROM m WHERE hit > 0 OR named)
SELECT id, project, path, shown AS name, kind, round(base + CASE kind WHEN 'function' THEN 10 ELSE 8 END + least(p_size * 0.5, 10) + CASE WHEN p_size % 5 = 0 THEN 3 ELSE 0 END, 1) AS score,
  concat_ws(', ', CASE WHEN hit > 0 THEN 'bm25' END, CASE WHEN named THEN 'name' END, CASE WHEN near >= 0.6 THEN 'fuzzy' END, CASE WHEN told THEN 'summary' END) AS match
FROM b WHERE base > 0 ORDER BY score DESC, id, project LIMIT 50
"""


@query(SEARCHED)
def keyword_search(spark, sf):
    """Parts of two words, by stored postings of their names and types; projects share ids, and a synonym is asked for too."""
    s = _symbols(spark, sf).withColumn("id", F.concat(F.lit("part:"), F.expr("cast(regexp_extract(id, '[0-9]+', 0) as long) div 2")))
    s = written(s.withColumn("n", F.regexp_extract("path", r"(\d+)", 1).cast("long")).groupBy("project", "id").agg(F.min_by(F.struct(*[c for c in s.columns if c not in ("project", "id")]), "n").alias("x")).select("project", "id", "x.*"), "symbols")
    at = f"{folder(spark)}/postings-{uuid.uuid4().hex}"
    K.save_postings(s.select(F.struct("project", "id").alias("key"), F.concat_ws(" ", "name", "summary").alias("text")), "key", "text", at)
    hits = K.search_postings(spark, at, "key", ["small", "new", "create"], k=1 << 20).select("key.project", "key.id", "score")
    return K.keyword_search(s, "small new", hits, k=50)


@query("""
WITH w AS (SELECT doc_id AS id, trim(substr(trim(regexp_replace(substr(text, greatest(strpos(lower(text), 'ing the') - 30, 1)), '\n', ' ', 'g')), 1, 10)) AS x FROM documents WHERE contains(lower(text), 'ing the'))
SELECT id, 'content' AS type FROM w
""")
def text_search(spark, sf):
    """Documents that hold two words in a row anywhere, case aside."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project"), F.lit("d.txt").alias("path"), F.lit("").alias("name"), F.col("text").alias("content"))
    return K.text_search(d, "ing the", "content", 1).select("id", "type")


@query("""
WITH r AS (SELECT p_brand AS project, p_partkey % 50 AS id, p_size AS path, p_partkey, unnest(string_split(lower(p_name), ' ')) AS term FROM part),
t AS (SELECT project, id, path, term FROM r QUALIFY row_number() OVER (PARTITION BY project, id, term ORDER BY p_partkey) = 1),
f AS (SELECT project, path FROM t GROUP BY ALL HAVING count(DISTINCT id) > 1), ft AS (SELECT DISTINCT project, path, term FROM t JOIN f USING (project, path)),
e AS (SELECT DISTINCT project, id AS source, (id + 1) % 50 AS target FROM t),
k AS (SELECT DISTINCT project, id, id // 10 AS caller FROM t), kt AS (SELECT k.project, caller, t.id, term FROM k JOIN t USING (project, id)),
ks AS (SELECT project, caller FROM kt GROUP BY ALL HAVING count(DISTINCT id) > 1), kx AS (SELECT DISTINCT project, caller, term FROM kt JOIN ks USING (project, caller)),
o AS (SELECT a.term AS x, b.term AS y, 2.0 AS c FROM e JOIN t a ON a.project = e.project AND a.id = source JOIN t b ON b.project = e.project AND b.id = target WHERE a.term <> b.term),
u AS (SELECT a.term AS x, b.term AS y, 1.0 AS c FROM ft a JOIN ft b USING (project, path) WHERE a.term <> b.term UNION ALL
  SELECT a.term, b.term, 1.5 FROM kx a JOIN kx b USING (project, caller) WHERE a.term <> b.term UNION ALL SELECT x, y, c FROM o UNION ALL SELECT y, x, c FROM o)
SELECT x, y, sum(c)::DOUBLE AS c FROM u GROUP BY 1, 2
""")
def concept_weights(spark, sf):
    """Terms of parts by shared file, edge and caller, brands being projects of which each has its own ids."""
    p = load(spark, sf, "part").select(F.col("p_brand").alias("project"), (F.col("p_partkey") % 50).alias("id"), F.col("p_size").alias("path"), F.explode(F.split(F.lower("p_name"), " ")).alias("term"), "p_partkey")
    terms = written(p.groupBy("project", "id", "term").agg(F.min_by("path", "p_partkey").alias("path")), "terms")
    ids = terms.select("project", "id").distinct()
    edges = ids.select("project", F.col("id").alias("source"), ((F.col("id") + 1) % 50).alias("target"))
    return K.concept_pairs(terms, edges, ids.select("project", F.col("id").alias("symbol_id"), F.floor(F.col("id") / 10).alias("caller_id")))


@query("""
SELECT s_suppkey AS id, x AS test FROM supplier, LATERAL (SELECT unnest(['p' || s_nationkey || '/tests/test_s' || s_suppkey || '.py', 'p' || s_nationkey || '/lib/s' || s_suppkey || '_test.py']) AS x)
WHERE s_suppkey % 2 = 0 OR NOT contains(x, 'tests/')
""")
def suggested_tests(spark, sf):
    """The tests of every supplier's file: one beside it, and for every second one in a folder of tests."""
    s = load(spark, sf, "supplier")
    files = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("p"), "s_nationkey", F.lit("/lib/s"), "s_suppkey", F.lit(".py")).alias("file"))
    beside = F.concat(F.lit("p"), "s_nationkey", F.lit("/lib/s"), "s_suppkey", F.lit("_test.py"))
    apart = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("p"), "s_nationkey", F.lit("/tests/test_s"), "s_suppkey", F.lit(".py")))
    paths = s.select(F.explode(F.array_compact(F.array(beside, apart, F.concat(F.lit("lib/s"), "s_suppkey", F.lit(".go"))))).alias("path"))
    return Q.suggested_tests(files, paths)


@query("""
WITH d AS (SELECT l_orderkey AS id, count(*) AS files, bool_or(l_returnflag = 'R') AS api, bool_or(l_linestatus = 'F' AND l_shipdate IS NOT NULL) AS gone,
  count(*) FILTER (l_returnflag <> 'A') AS added, 2 * count(*) FILTER (l_linestatus = 'F') AS deleted FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
s AS (SELECT *, CASE WHEN files > 20 THEN 20 WHEN files > 10 THEN 10 WHEN files > 5 THEN 5 ELSE 0 END + CASE WHEN added > 0 AND deleted > 2 * added THEN 10 ELSE 0 END + CASE WHEN api THEN 15 ELSE 0 END + CASE WHEN gone THEN 20 ELSE 0 END AS score FROM d)
SELECT id, files, added, deleted, concat_ws(',', CASE WHEN api THEN 'api' END, CASE WHEN gone THEN 'breaking' END) AS touches, score,
  CASE WHEN score >= 70 THEN 'critical' WHEN score >= 45 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS level FROM s
""")
def request_risk(spark, sf):
    """Every order a change request, every line item a file of it: returned ones touch routes, closed ones drop a function."""
    name = F.concat(F.when(F.col("l_returnflag") == "R", F.lit("src/api/p")).otherwise(F.lit("src/p")), "l_partkey", F.lit("_"), "l_linenumber", F.lit(".py"))
    plus = F.when(F.col("l_returnflag") != "A", F.lit("+x = 1\n")).otherwise("")
    minus = F.when(F.col("l_linestatus") == "F", F.lit("-def gone(a, b):\n-    return a\n")).otherwise("")
    section = F.concat(F.lit("diff --git a/x b/x\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1 +1 @@\n"), minus, plus, F.lit(" same"))
    l = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.collect_list(section), "\n").alias("text"))  # noqa: E741
    return Q.risk(l.join(load(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id"))


@query(
    SQL
    + """
, t AS (SELECT 'p' || n AS project, 'lib/s' || s || '.py:function:help' || s AS target, count(k) AS sites FROM f LEFT JOIN c USING (n, s) GROUP BY ALL)
SELECT project || ':' || target AS target, sites, CASE WHEN sites > 0 THEN 1 ELSE 0 END AS projects, CASE WHEN sites = 0 THEN 'safe' WHEN sites > 3 THEN 'high' ELSE 'moderate' END AS risk, 'All call sites will break.' AS meaning FROM t
"""
)
def edit_preview(spark, sf):
    """What deleting each nation's first helper would break."""
    symbols, edges, files = scanned(spark, sf)
    full = lambda c: F.concat("project", F.lit(":"), F.col(c))
    found = R.resolved(symbols, edges).where("found is not null")
    callers = found.select("project", F.col("found").alias("symbol_id"), F.col("source").alias("caller_id"))
    first = load(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s"))
    targets = first.select(F.concat(F.lit("p"), "s_nationkey").alias("project"), F.concat(F.lit("lib/s"), "s", F.lit(".py:function:help"), "s").alias("id"))
    out = P2.edit_risk(P2.call_sites(callers, symbols, R.contents(symbols, files), targets), targets, "delete")
    return out.withColumn("target", full("target")).drop("project")


@query(
    SQL
    + """
SELECT 'p' || s_nationkey || ':lib/s' || s_suppkey || '.py:function:table' || s_suppkey AS target, false AS entry, 4 AS nodes, 'p' || n || ':app/c' || k || '.py:function:run' || k AS first
FROM supplier JOIN c ON s = s_suppkey UNION ALL
SELECT 'p' || s_nationkey || ':lib/s' || s_suppkey || '.py:function:table' || s_suppkey, false, 3, 'p' || s_nationkey || ':lib/s' || s_suppkey || '.py:function:help' || s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s FROM c)
"""
)
def trace_up(spark, sf):
    """Paths down to every library's table: from programs where the library is called."""
    symbols, edges, files = scanned(spark, sf)
    full = lambda c: F.concat("project", F.lit(":"), F.col(c))
    known = R.reverse_of_files(symbols, edges, files).where("caller_id not like '%:file:%'")
    callers = written(known.select(full("symbol_id").alias("symbol_id"), full("caller_id").alias("caller_id")), "callers")
    s = symbols.select(full("id").alias("id"), "kind", "name", F.lit(False).alias("exported"), F.lit(1).alias("refs"))
    targets = symbols.where("name like 'table%'").select(full("id").alias("id"))
    return P2.trace_up(callers, s, targets).select("target", "entry", F.size("path").alias("nodes"), F.element_at("path", 1).alias("first"))


@query("""
SELECT 'api/s' || s_suppkey || '.py' AS path, line, CASE line WHEN 1 THEN CASE s_nationkey % 3 WHEN 0 THEN 'wrong_key' WHEN 1 THEN 'missing_ok' END END AS issue FROM supplier, (VALUES (1), (3)) l(line)
""")
def answer_forms(spark, sf):
    """Every supplier a file of an interface that answers twice."""
    first = F.when(F.expr("s_nationkey % 3 = 0"), F.lit('return {"success": 1}')).when(F.expr("s_nationkey % 3 = 1"), F.lit('return {"data": 1}')).otherwise(F.lit('return {"ok": 1, "data": 2}'))
    text = F.concat(first, F.lit("\n# return {}\nreturn {'ok': False}\n"))
    return Q.answers(load(spark, sf, "supplier").select(F.concat(F.lit("api/s"), "s_suppkey", F.lit(".py")).alias("path"), text.alias("text"))).select("path", "line", "issue")


def _tree(spark, sf):
    """Every nation a project with a TypeScript library, programs that import from it in six ways, a Go command and its configuration."""
    nation, supplier, customer = load(spark, sf, "nation"), _rows(spark, sf, "supplier"), _rows(spark, sf, "customer")
    project = lambda c: F.concat(F.lit("p"), F.col(c)).alias("project")
    row = lambda df, n, path, text: df.select(project(n), path.alias("path"), text.alias("text"))
    first = supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("s"))
    lib = F.concat(F.lit("s"), "s")
    forms = [F.concat(F.lit("../lib/"), lib), F.concat(F.lit("@/lib/"), lib), F.concat(F.lit("@lib/"), lib, F.lit(".js")), F.lit("../lib"), F.lit("react"), F.concat(F.lit("loop/"), lib)]
    module = F.element_at(F.array(*forms), (F.col("c_custkey") % 6 + 1).cast("int"))
    text = F.concat(F.lit("import { x } from '"), module, F.lit("'\nimport y from './none'\n"))
    config = """{
      // prefixes
      "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["old/*"], "@/lib/*": ["./src/lib/*", "x/*"], "@lib/*": ["@/lib/*"], "loop/*": ["pool/*"], "pool/*": ["loop/*"], "only": ["src/lib/index.ts"]}}
    }"""
    out = row(supplier, "s_nationkey", F.concat(F.lit("src/lib/s"), "s_suppkey", F.lit(".ts")), F.lit("export const x = 1\n"))
    out = out.union(row(customer.join(first, "c_nationkey"), "c_nationkey", F.concat(F.lit("src/app/c"), "c_custkey", F.lit(".ts")), text))
    go = F.concat(F.lit('package main\nimport (\n\t"fmt"\n\t"example.com/p'), "n_nationkey", F.lit('/pkg/m"\n)\n'))
    for path, said in (
        ("src/lib/index.ts", F.lit("export * from './index'\n")), ("tsconfig.json", F.lit(config)), ("cmd/main.go", go), ("go.mod", F.concat(F.lit("module example.com/p"), "n_nationkey", F.lit("\n\ngo 1.22\n"))),
        ("pkg/m/a_test.go", F.lit("package m\n")), ("pkg/m/m.go", F.lit("package m\n")), ("pkg/m/n.go", F.lit("package m\n")),
    ):
        out = out.union(row(nation, "n_nationkey", F.lit(path), said))
    return out


def _resolved_paths(spark, sf):
    files = written(_tree(spark, sf), "tree")
    rows = written(P.scan(files.where("not endswith(path, '.json')")), "scan")
    imports = P.edges(rows).where("type = 'imports'").select("project", R.path_of(F.col("source")).alias("path"), F.col("target").alias("module"), "line")
    return A.resolve(imports, files.select("project", "path"), A.configured(files), A.go_modules(files))


PATHS = (
    SQL
    + """
, r AS (
  SELECT 'p' || n AS project, 'src/app/c' || k || '.ts' AS path, 1 AS line,
    CASE k % 6 WHEN 0 THEN '../lib/s' || s WHEN 1 THEN '@/lib/s' || s WHEN 2 THEN '@lib/s' || s || '.js' WHEN 3 THEN '../lib' WHEN 4 THEN 'react' ELSE 'loop/s' || s END AS module,
    CASE WHEN k % 6 < 3 THEN 'src/lib/s' || s || '.ts' WHEN k % 6 = 3 THEN 'src/lib/index.ts' END AS found, CASE WHEN k % 6 IN (0, 3) THEN 'relative' WHEN k % 6 < 3 THEN 'alias' END AS stage FROM c
  UNION ALL SELECT 'p' || n, 'src/app/c' || k || '.ts', 2, './none', NULL, NULL FROM c
  UNION ALL SELECT 'p' || n_nationkey, 'src/lib/index.ts', 1, './index', 'src/lib/index.ts', 'relative' FROM nation
  UNION ALL SELECT 'p' || n_nationkey, 'cmd/main.go', 3, 'fmt', NULL, NULL FROM nation
  UNION ALL SELECT 'p' || n_nationkey, 'cmd/main.go', 4, 'example.com/p' || n_nationkey || '/pkg/m', 'pkg/m/m.go', 'module' FROM nation)
"""
)


@query(PATHS + "SELECT * FROM r")
def resolve_aliases(spark, sf):
    return _resolved_paths(spark, sf)


@query(PATHS + "SELECT project, path AS from_file, found AS to_file, line, 'app' AS from_layer, 'lib' AS to_layer, 'cannot_import' AS kind FROM r WHERE stage = 'alias'")
def alias_breaches(spark, sf):
    """Programs may not import from the library by an alias: layers of resolved imports."""
    found = _resolved_paths(spark, sf).where("stage = 'alias'").select(F.concat_ws(":", "project", "path").alias("from_file"), F.concat_ws(":", "project", "found").alias("to_file"), "line")
    out = U.layer_breaches(found, {"app": ["*:src/app/*"], "lib": ["*:src/lib/*"]}, {}, {"app": ["lib"]})
    own = lambda c: F.expr(f"substring({c}, instr({c}, ':') + 1)").alias(c)
    return out.select(F.substring_index("from_file", ":", 1).alias("project"), own("from_file"), own("to_file"), "line", "from_layer", "to_layer", "kind")


def _flowing(spark, sf):
    """Every customer a program that sends a secret and an open value through one helper of its nation's library."""
    first = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("s_suppkey"))
    lib = _text("def same", "s_suppkey", "(x):\n    return x\n\ndef twice", "s_suppkey", "(z):\n    return same", "s_suppkey", "(z)\n\ndef whole", "s_suppkey", "(y: int):\n    return y\n")
    app = _text(
        "from s", "s_suppkey", " import same", "s_suppkey", ", twice", "s_suppkey", ", whole", "s_suppkey", "\n\ndef save", "c_custkey", "(secret, public):\n    a = twice", "s_suppkey", "(secret)\n    b = same", "s_suppkey",
        "(public)\n    c = whole", "s_suppkey", "(secret)\n    store", "c_custkey", "(text=a)\n    show", "c_custkey", "(b)\n    count", "c_custkey", "(c)\n\ndef store", "c_custkey",
        "(text):\n    pass\n\ndef show", "c_custkey", "(w):\n    pass\n\ndef count", "c_custkey", "(n):\n    pass\n",
    )
    project = F.concat(F.lit("p"), "c_nationkey").alias("project")
    libs = first.select(project, F.concat(F.lit("lib/s"), "s_suppkey", F.lit(".py")).alias("path"), lib.alias("text"))
    return libs.union(_rows(spark, sf, "customer").join(first, "c_nationkey").select(project, F.concat(F.lit("app/c"), "c_custkey", F.lit(".py")).alias("path"), app.alias("text")))


FLOW = (
    SQL.replace("WITH f", "WITH RECURSIVE f")
    + """
, fn AS (SELECT *, 'p' || n AS project, 'app/c' || k || '.py:function:' AS a, 'lib/s' || s || '.py:function:' AS l FROM c),
steps(project, fn, var, to_fn, to_var, call, via) AS (
  SELECT project, a || 'save' || k, 'secret', l || 'twice' || s, 'z', a || 'save' || k || '@4', NULL FROM fn UNION
  SELECT project, a || 'save' || k, 'public', l || 'same' || s, 'x', a || 'save' || k || '@5', NULL FROM fn UNION
  SELECT project, l || 'twice' || s, 'z', l || 'same' || s, 'x', l || '@twice', NULL FROM fn UNION
  SELECT project, l || 'same' || s, 'x', l || 'same' || s, 'return', NULL, NULL FROM fn UNION
  SELECT project, l || 'same' || s, 'return', l || 'twice' || s, 'return', NULL, l || '@twice' FROM fn UNION
  SELECT project, l || 'same' || s, 'return', a || 'save' || k, 'b', NULL, a || 'save' || k || '@5' FROM fn UNION
  SELECT project, l || 'twice' || s, 'return', a || 'save' || k, 'a', NULL, a || 'save' || k || '@4' FROM fn UNION
  SELECT project, a || 'save' || k, 'a', a || 'store' || k, 'text', a || 'save' || k || '@7', NULL FROM fn UNION
  SELECT project, a || 'save' || k, 'b', a || 'show' || k, 'w', a || 'save' || k || '@8', NULL FROM fn),
r(project, start, fn, var, calls) AS (
  SELECT project, a || 'save' || k, a || 'save' || k, 'secret', []::VARCHAR[] FROM fn UNION
  SELECT r.project, r.start, t.to_fn, t.to_var, CASE WHEN t.call IS NOT NULL THEN list_append(r.calls, t.call) WHEN t.via IS NOT NULL THEN r.calls[:-2] ELSE r.calls END
  FROM r JOIN steps t ON t.project = r.project AND t.fn = r.fn AND t.var = r.var AND (t.via IS NULL OR len(r.calls) = 0 OR t.via = r.calls[-1]))
"""
)


@query(FLOW + "SELECT DISTINCT project, start, fn, var AS param FROM r WHERE var IN ('z', 'x', 'text', 'w')")
def data_flow(spark, sf):
    """Where every program's secret goes: through the helper to what it is stored by, not to what the open value is shown by."""
    files = _flowing(spark, sf)
    rows, facts = written(P.scan(files), "scan"), written(L.facts(files), "facts")
    moves = D.steps(facts, R.resolved(P.symbols(rows), P.edges(rows)).where("type = 'calls'"))
    return D.reached_parameters(facts, D.flow(moves, D.named_starts(facts, "secret"))).select("project", "start", "fn", "param")


@query("""
WITH s AS (SELECT s_suppkey AS s, s_nationkey AS n, 'lib/s' || s_suppkey || '.py' AS source FROM supplier),
won AS (SELECT n, min(source) AS source FROM s WHERE s % 2 = 1 GROUP BY 1), any_ AS (SELECT n, min(source) AS source FROM s GROUP BY 1)
SELECT 'p' || n AS project, source, 'tests/test_s' || s || '.py' AS test, 1000 AS weight, true AS first FROM s WHERE s % 2 = 0 UNION ALL
SELECT 'p' || n, source, 'tests/flow' || s || '.py', 102, s % 2 = 1 AND source NOT IN (SELECT source FROM won WHERE won.n = s.n) FROM s UNION ALL
SELECT 'p' || n, source, 'tests/all.py', 102, true FROM won UNION ALL SELECT 'p' || n, source, 'tests/all.py', 102, false FROM any_ WHERE n NOT IN (SELECT n FROM won)
""")
def tests_by_imports(spark, sf):
    """Tests of every nation's library: by name for every second file, one that imports each file, one that imports all."""
    s = _rows(spark, sf, "supplier")
    project = F.concat(F.lit("p"), "s_nationkey").alias("project")
    use = lambda c: F.concat(F.lit("from s"), c, F.lit(" import help"), c, F.lit("\n\ndef test"), c, F.lit("():\n    help"), c, F.lit("()\n"))
    lib = s.select(project, F.concat(F.lit("lib/s"), "s_suppkey", F.lit(".py")).alias("path"), F.concat(F.lit("def help"), "s_suppkey", F.lit("():\n    pass\n")).alias("text"))
    flow = s.select(project, F.concat(F.lit("tests/flow"), "s_suppkey", F.lit(".py")), use(F.col("s_suppkey").cast("string")))
    own = s.where("s_suppkey % 2 = 0").select(project, F.concat(F.lit("tests/test_s"), "s_suppkey", F.lit(".py")), F.lit("def test():\n    pass\n"))
    every = s.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list(use(F.col("s_suppkey").cast("string")))), "\n").alias("text")).select(project, F.lit("tests/all.py"), "text")
    files = written(lib.union(flow).union(own).union(every), "files")
    rows = written(P.scan(files), "scan")
    symbols, edges = P.symbols(rows), P.edges(rows)
    callers = R.callers(symbols, edges, R.resolved(symbols, edges))
    return T.assigned(T.evidence(files, R.imported_symbols(symbols, edges), callers)).withColumn("weight", F.col("weight").cast("int"))


@query("""
WITH d AS (SELECT s_nationkey AS n, 'Pkg' || s_suppkey AS name FROM supplier),
i AS (SELECT DISTINCT c_nationkey AS n, 'pkg' || (c_custkey % 40) || '.sub' || c_custkey AS target FROM customer WHERE c_custkey % 3 = 0),
r AS (SELECT n, name, EXISTS (SELECT 1 FROM i WHERE i.n = d.n AND contains(target, lower(name))) AS reachable FROM d)
SELECT 'p' || n AS project, count(*) AS total, count(*) FILTER (reachable) AS reachable, count(*) FILTER (NOT reachable) AS unreachable, round_even(count(*) FILTER (NOT reachable) / count(*) * 100, 0)::INT AS pct FROM r GROUP BY 1
""")
def package_reach(spark, sf):
    """Packages that every nation's requirements name, and how many of them some program of it imports."""
    s, c = load(spark, sf, "supplier"), _rows(spark, sf, "customer").where("c_custkey % 3 = 0")
    wanted = s.groupBy("s_nationkey").agg(F.array_join(F.collect_list(F.concat(F.lit("Pkg"), "s_suppkey", F.lit("==1.0"))), "\n").alias("text"))
    files = wanted.select(F.concat(F.lit("p"), "s_nationkey").alias("project"), F.lit("requirements.txt").alias("path"), "text")
    code = c.select(F.concat(F.lit("p"), "c_nationkey").alias("project"), F.concat(F.lit("c"), "c_custkey", F.lit(".py")).alias("path"), F.concat(F.lit("import pkg"), F.col("c_custkey") % 40, F.lit(".sub"), "c_custkey", F.lit("\n")).alias("text"))
    declared = M.packages(files.select(F.concat_ws("/", "project", "path").alias("path"), "text")).where("kind = 'declared'").select(F.substring_index("path", "/", 1).alias("project"), "name")
    edges = P.edges(P.scan(code)).where("type = 'imports'").select("project", "target")
    return J.reach(J.reachable(declared, edges))
