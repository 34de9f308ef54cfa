"""Queries of the parsers: rows of the driver's tables are written as logs, reports, manifests and sources, and parsed back.

The twins state the same rows without the detour, so they check every parser on whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.shared import dealt, written
from tessera.operators import project as J
from tessera.operators import rules as U
from tessera.operators import security as S
from tessera.plans import risk as V
from tessera.plans.registry import query
from tessera.sources import catalog as K
from tessera.sources import code as P
from tessera.sources import histories as H
from tessera.sources import manifests as M
from tessera.sources import metrics as N
from tessera.sources import schemas as T
from tessera.sources.tables import load


def _orders(spark, sf, line, *columns):
    """One text per order: its header's columns and its lines in order, at most seven."""
    l = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("s")))), lambda x: x["s"]), "\n").alias("lines"))  # noqa: E741
    return load(spark, sf, "orders").select(*columns, "o_orderkey").join(l, F.col("o_orderkey") == F.col("l_orderkey"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS commit, CAST(epoch(o_orderdate) AS BIGINT) AS ts, CAST(o_custkey AS VARCHAR) AS author, 'p|' || o_orderpriority AS message,
  'part/' || l_partkey || '-' || l_linenumber AS path, CAST(l_quantity AS BIGINT) AS insertions, CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_linenumber END AS BIGINT) AS deletions
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
""")
def git_log_numstat(spark, sf):
    gone = F.when(F.col("l_returnflag") == "R", "-").otherwise(F.col("l_linenumber").cast("string"))
    line = F.concat(F.col("l_quantity").cast("long"), F.lit("\t"), gone, F.lit("\tpart/"), "l_partkey", F.lit("-"), "l_linenumber")
    o = _orders(spark, sf, line, "o_orderdate", "o_custkey", "o_orderpriority")
    head = F.concat(F.lit("COMMIT:"), "o_orderkey", F.lit("|"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")), F.lit("|"), "o_custkey", F.lit("|p|"), "o_orderpriority")
    return H.log_numstat(o.select(F.concat(head, F.lit("\n\n"), "lines", F.lit("\n")).alias("text")), "text")


@query("""
SELECT l_orderkey AS id, 'supp/' || l_suppkey || '/' || l_linenumber AS path, CAST(l_linenumber * 100 AS BIGINT) AS start, CAST(l_linenumber * 100 + l_quantity - 1 AS BIGINT) AS "end"
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R'
""")
def diff_ranges(spark, sf):
    target = F.when(F.col("l_returnflag") == "R", F.lit("+++ /dev/null")).otherwise(F.concat(F.lit("+++ b/supp/"), "l_suppkey", F.lit("/"), "l_linenumber"))
    line = F.concat(F.lit("--- a/old\n"), target, F.lit("\n@@ -1,2 +"), (F.col("l_linenumber") * 100).cast("string"), F.lit(","), F.col("l_quantity").cast("long").cast("string"), F.lit(" @@ x\n+y\n@@ -9 +9,0 @@"))
    return H.diff_ranges(_orders(spark, sf, line).select(F.col("o_orderkey").alias("id"), "lines"), "lines", "id")


@query("SELECT user_id AS id, event_type AS path, event_id + 1 AS line FROM events WHERE event_type <> 'view'")
def coverage_report(spark, sf):
    hits = F.when(F.col("event_type") == "view", "0").otherwise("3")
    text = F.concat(F.lit('<coverage><class name="c" filename="'), "event_type", F.lit('"><lines><line number="'), (F.col("event_id") + 1).cast("string"), F.lit('" hits="'), hits, F.lit('"/></lines></class></coverage>'))
    return H.coverage_xml(load(spark, sf, "events").select(F.col("user_id").alias("id"), text.alias("text")), "text", "id")


@query("SELECT user_id AS id, event_id % 64 + 1 AS line FROM events GROUP BY ALL")
def coverage_bitmap(spark, sf):
    e = load(spark, sf, "events").withColumn("n", F.col("event_id") % 64)
    zero, one = (lambda n: F.repeat(F.lit("00"), n.cast("int"))), F.expr("lpad(hex(shiftleft(1, cast(n % 8 as int))), 2, '0')")
    return H.numbits(e.select(F.col("user_id").alias("id"), F.unhex(F.concat(zero(F.expr("n div 8")), one)).alias("b")), "b", "id").distinct()


def _packages(spark, sf):
    """Every order a project with requirements, and a lock file of some of them."""
    wanted = _orders(spark, sf, F.concat(F.lit("part-"), "l_partkey", F.lit(" >= "), F.col("l_quantity").cast("long").cast("string"), F.lit(" # c")))
    locked = _orders(spark, sf, F.when(F.col("l_returnflag") == "R", F.concat(F.lit('[[package]]\nname = "part-'), "l_partkey", F.lit('"\nversion = "9.'), "l_linenumber", F.lit('"'))))
    files = wanted.select(F.concat("o_orderkey", F.lit("/requirements.txt")).alias("path"), F.col("lines").alias("text")).unionByName(
        locked.select(F.concat("o_orderkey", F.lit("/poetry.lock")).alias("path"), F.col("lines").alias("text"))
    )
    return M.packages(files).withColumn("project", F.substring_index("path", "/", 1).cast("long"))


@query("""
WITH l AS (SELECT l_orderkey AS project, 'part-' || l_partkey AS name, '>=' || CAST(l_quantity AS BIGINT) AS version, l_returnflag, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
pins AS (SELECT project, name, max('9.' || l_linenumber) AS pinned FROM l WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT l.project, l.project || '/requirements.txt' AS path, 'pypi' AS ecosystem, l.name, version, 'production' AS scope, pinned FROM l LEFT JOIN pins USING (project, name)
""")
def package_inventory(spark, sf):
    return M.inventory(_packages(spark, sf), "project")


@query("""
SELECT l_orderkey AS project, 'pypi' AS ecosystem, 'part-' || l_partkey AS name, count(DISTINCT l_quantity) AS versions
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL HAVING count(DISTINCT l_quantity) > 1
""")
def version_conflicts(spark, sf):
    found = _packages(spark, sf).where("kind = 'declared'")
    return M.conflicts(found, "project").withColumn("versions", F.size("versions").cast("long"))


ECOSYSTEM = "CASE p_partkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'maven' WHEN 2 THEN 'go' ELSE 'pypi' END"


@query(f"""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pkg:npm/%40s/p' WHEN 1 THEN 'pkg:maven/g/p' WHEN 2 THEN 'pkg:golang/p' ELSE 'pkg:pypi/p' END || p_partkey || '@' || p_size AS purl FROM part
""")
def package_urls(spark, sf):
    name = F.concat(F.expr("CASE p_partkey % 4 WHEN 0 THEN '@s/p' WHEN 1 THEN 'g:p' ELSE 'p' END"), "p_partkey")
    return load(spark, sf, "part").select("p_partkey", M.purl(F.expr(ECOSYSTEM), name, F.concat(F.lit("^>= "), "p_size")).alias("purl"))


@query("""
WITH c AS (SELECT DISTINCT l_orderkey AS project, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT project, count(*) AS components, min('part-' || l_partkey) AS first FROM c GROUP BY 1
""")
def bill_of_materials(spark, sf):
    """Bills read back from their JSON; components of one package in two versions count once by name."""
    docs = M.sbom(M.inventory(_packages(spark, sf), "project"), "project")
    names = F.array_distinct(F.from_json("sbom", "components array<struct<name: string>>")["components"]["name"])
    return docs.select("project", F.size(names).cast("long").alias("components"), F.array_min(names).alias("first"))


LICENCE = "CASE s_nationkey % 6 WHEN 0 THEN 'MIT' WHEN 1 THEN 'AGPL-3.0' WHEN 2 THEN 'LGPL' WHEN 3 THEN 'MPL-2.0' WHEN 4 THEN '' END"


@query("SELECT s_suppkey, CASE s_nationkey % 6 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'high' ELSE 'medium' END AS risk FROM supplier WHERE s_nationkey % 6 > 0")
def license_policy(spark, sf):
    s = load(spark, sf, "supplier").select("s_suppkey", F.expr(LICENCE).alias("licence"))
    return s.select("s_suppkey", M.license_risk(F.col("licence")).alias("risk")).where("risk is not null")


def _sources(spark, sf):
    """Every customer a Python file, every supplier a Go file."""
    c = dealt(load(spark, sf, "customer").select("c_custkey", "c_nationkey"))
    body = F.concat(
        F.lit('"""customer"""\nimport nation.n'), "c_nationkey", F.lit("\n\nclass C"), "c_custkey", F.lit("(n"), "c_nationkey", F.lit('.Base):\n    def serve(self, x: int) -> str:\n        """Serves."""\n        return n'),
        "c_nationkey", F.lit(".call(x) + '(skip(1))'  # no(2)\n"),
    )
    s = dealt(load(spark, sf, "supplier").select("s_suppkey", "s_nationkey"))
    go = F.concat(F.lit('package s\n\nimport "nation/n'), "s_nationkey", F.lit('"\n\ntype S'), "s_suppkey", F.lit(" struct {\n\tBase\n}\n\nfunc (s *S"), "s_suppkey", F.lit(") Serve(x int) string {\n\t// no(1)\n\treturn n"), "s_nationkey", F.lit('.Call(x, "skip(")\n}\n'))
    name = lambda p, k, e: F.concat(F.lit(p), F.col(k), F.lit(e)).alias("path")
    return c.select(F.lit("customer").alias("project"), name("c", "c_custkey", ".py"), body.alias("text")).unionByName(s.select(F.lit("supplier").alias("project"), name("s", "s_suppkey", ".go"), go.alias("text")))


@query("""
SELECT 'customer' AS project, 'c' || c_custkey || '.py' AS path, kind, CASE kind WHEN 'class' THEN 'C' || c_custkey ELSE 'C' || c_custkey || '.serve' END AS name,
  CASE kind WHEN 'class' THEN 4 ELSE 5 END AS start_line, 7 AS end_line, CASE kind WHEN 'class' THEN '' ELSE 'x' END AS params FROM customer, (VALUES ('class'), ('method')) k(kind)
UNION ALL
SELECT 'supplier', 's' || s_suppkey || '.go', kind, CASE kind WHEN 'class' THEN 'S' || s_suppkey ELSE 'S' || s_suppkey || '.Serve' END,
  CASE kind WHEN 'class' THEN 5 ELSE 9 END, CASE kind WHEN 'class' THEN 7 ELSE 12 END, CASE kind WHEN 'class' THEN '' ELSE 'x' END FROM supplier, (VALUES ('class'), ('method')) k(kind)
""")
def scan_symbols(spark, sf):
    return P.symbols(P.scan(_sources(spark, sf))).select("project", "path", "kind", "name", "start_line", "end_line", F.array_join("params", ",").alias("params"))


@query("""
WITH c AS (SELECT 'customer' AS project, 'c' || c_custkey AS f, 'C' || c_custkey AS k, 'n' || c_nationkey AS n FROM customer),
s AS (SELECT 'supplier' AS project, 's' || s_suppkey AS f, 'S' || s_suppkey AS k, 'n' || s_nationkey AS n FROM supplier)
SELECT project, f || '.py:file:' || f AS source, 'nation.' || n AS target, 'imports' AS type, 2 AS line FROM c UNION ALL
SELECT project, f || '.py:class:' || k, n || '.Base', 'extends', 4 FROM c UNION ALL
SELECT project, f || '.py:method:' || k || '.serve', n || '.call', 'calls', 7 FROM c UNION ALL
SELECT project, f || '.go:file:' || f, 'nation/' || n, 'imports', 3 FROM s UNION ALL
SELECT project, f || '.go:class:' || k, 'Base', 'extends', 6 FROM s UNION ALL
SELECT project, f || '.go:method:' || k || '.Serve', n || '.Call', 'calls', 11 FROM s
""")
def scan_edges(spark, sf):
    return P.edges(P.scan(_sources(spark, sf))).drop("names")


@query("""
SELECT 'c' || c_custkey || '.py' AS path, 'view' AS function, 'request.args' AS origin,
  CASE c_nationkey % 3 WHEN 0 THEN 'sql_injection' ELSE 'deserialization' END AS category, 'critical' AS severity, CASE c_nationkey % 3 WHEN 0 THEN 0 ELSE 1 END AS hops
FROM customer WHERE c_nationkey % 3 < 2
""")
def taint_flows(spark, sf):
    """A third of the files flow straight into a sink, a third through their own helper, a third are sanitized."""
    direct = F.lit("def view():\n    q = request.args['q']\n    cursor.execute('a' + q)\n")
    through = F.concat(F.lit("def h"), "c_custkey", F.lit("(k, v):\n    return pickle.loads(v)\ndef view():\n    q = request.args['q']\n    h"), "c_custkey", F.lit("(1, q)\n"))
    safe = F.lit("def view():\n    q = int(request.args['q'])\n    cursor.execute('a', (q,))\n    eval(q)\n")
    kind = F.col("c_nationkey") % 3
    files = dealt(load(spark, sf, "customer").select("c_custkey", "c_nationkey")).select(F.concat(F.lit("c"), "c_custkey", F.lit(".py")).alias("path"), F.when(kind == 0, direct).when(kind == 1, through).otherwise(safe).alias("text"))
    return S.taint(written(S.flows(files), "flows")).select("path", "function", "origin", "category", "severity", "hops")


@query("""
SELECT 's' || s_suppkey || '/Dockerfile' AS path, line, rule, severity FROM supplier, (VALUES (1, 'FROM_LATEST', 'medium', 0), (1, 'NO_USER', 'high', 1), (2, 'EXPOSE_SENSITIVE_PORT', 'medium', 2), (3, 'PIPE_TO_SHELL', 'critical', 1)) r(line, rule, severity, k)
WHERE CASE k WHEN 0 THEN s_nationkey % 2 = 0 WHEN 1 THEN true ELSE s_nationkey % 5 = 0 END
""")
def infrastructure_issues(spark, sf):
    image = F.when(F.col("s_nationkey") % 2 == 0, "base").otherwise("base:1.0")
    port = F.when(F.col("s_nationkey") % 5 == 0, "6379").otherwise("8080")
    text = F.concat(F.lit("FROM "), image, F.lit("\nEXPOSE "), port, F.lit("\nRUN curl x | sh\n"))
    return S.infrastructure(load(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit("/Dockerfile")).alias("path"), text.alias("text")))


@query()
def line_findings(spark, sf):
    """Every line rule over every document."""
    return S.line_findings(load(spark, sf, "documents").select(F.concat("doc_id", F.lit(".py")).alias("path"), "text"))


#: Lines that a rule finds, by what an order's number leaves over of 6; the rest speaks of them only.
RISKY = ["x = eval(value)", "h = hashlib.md5(data)", "DEBUG = True", "# x = eval(value)", "requests.get(url, verify=False)", "n = random.randint(1, 6)"]


@query("""
WITH o AS (SELECT 'o' || o_orderkey || CASE o_orderkey % 2 WHEN 0 THEN '.py' ELSE '.go' END AS path, o_orderkey % 6 AS k, o_orderkey % 2 = 0 AS py FROM orders)
SELECT path, 2::INT AS line, rule, severity FROM o JOIN (VALUES (0, 'eval()', 'high', false), (0, 'UNSAFE_EVAL', 'high', true), (1, 'WEAK_HASH_MD5', 'high', false), (2, 'DEBUG_ENABLED_DJANGO', 'medium', true),
  (3, 'UNSAFE_EVAL', 'high', true), (4, 'TLS_VERIFY_DISABLED_PY', 'high', true), (5, 'INSECURE_RANDOM_PY', 'low', true)) r(k, rule, severity, only_py) USING (k) WHERE py OR NOT only_py
""")
def risky_lines(spark, sf):
    """Every order a file of Python or Go with a line that rules find, or that only speaks of one."""
    line = F.element_at(F.array(*map(F.lit, RISKY)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    path = F.concat(F.lit("o"), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, ".py").otherwise(".go"))
    return S.line_findings(load(spark, sf, "orders").select(path.alias("path"), F.concat(F.lit("a = 1\n"), line, F.lit("\nb = 2\n")).alias("text"))).select("path", "line", "rule", "severity")


def _models(spark, sf):
    """Every customer a Python model, every supplier of the same key a TypeScript one."""
    py = F.concat(F.lit("from pydantic import BaseModel\nclass M"), "c_custkey", F.lit("(BaseModel):\n    id: int\n    tags: list[str] = []\n    note: "), F.when(F.col("c_nationkey") % 2 == 0, "Optional[str]").otherwise("str"), F.lit("\n    only: bool\n"))
    ts = F.concat(F.lit("export interface M"), "s_suppkey", F.lit(" {\n  id: "), F.when(F.col("s_nationkey") % 3 == 0, "string").otherwise("number"), F.lit(";\n  tags: Array<string>,\n  note?: string | null;\n  more: Record<string, number>\n}\n"))
    c = dealt(load(spark, sf, "customer").select("c_custkey", "c_nationkey")).select(F.lit("a").alias("project"), F.lit("m.py").alias("path"), py.alias("text"))
    return c.unionByName(dealt(load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")).select(F.lit("b").alias("project"), F.lit("m.ts").alias("path"), ts.alias("text")))


@query("""
WITH b AS (SELECT s_suppkey AS k, s_nationkey AS s, c_nationkey AS c FROM supplier JOIN customer ON s_suppkey = c_custkey)
SELECT 'M' || k AS model, 'b' AS project, 'a' AS first_project, field, issue, severity
FROM b, (VALUES ('only', 'missing_in_consumer', 'info', 0), ('more', 'missing_in_producer', 'error', 0), ('id', 'type_mismatch', 'error', 1), ('note', 'type_mismatch', 'error', 2)) r(field, issue, severity, w)
WHERE w = 0 OR (w = 1 AND s % 3 = 0) OR (w = 2 AND c % 2 = 1)
""")
def contract_drift(spark, sf):
    found = written(T.models(_models(spark, sf)), "models")
    return T.drift(written(T.inherited(found.withColumn("bases", F.array().cast("array<string>")), depth=1), "fields"))


@query("""
WITH s AS (SELECT user_id AS path, event_id AS id, event_id * 10 AS a, event_id * 10 + CAST(floor(value) AS BIGINT) % 9 AS b FROM events),
r AS (SELECT user_id AS path, event_id * 10 - 35 AS a, event_id * 10 - 30 AS b FROM events WHERE event_type = 'click')
SELECT DISTINCT s.path, s.id FROM s JOIN r ON s.path = r.path AND s.a <= r.b AND r.a <= s.b
""")
def changed_symbols(spark, sf):
    e = load(spark, sf, "events").withColumn("path", F.col("user_id"))
    s = e.select("path", F.col("event_id").alias("id"), (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + F.floor("value") % 9).alias("end"))
    r = e.where("event_type = 'click'").select("path", (F.col("event_id") * 10 - 35).alias("start"), (F.col("event_id") * 10 - 30).alias("end"))
    return J.changed_symbols(s, r)


def _tree(spark, sf):
    """Every part a source file; parts of even size have a test."""
    p = load(spark, sf, "part")
    src = p.select(F.col("p_brand").alias("project"), F.concat(F.lit("src/a"), "p_size", F.lit("/f"), "p_partkey", F.lit(".py")).alias("path"))
    tests = p.where("p_size % 2 = 0").select(F.col("p_brand").alias("project"), F.concat(F.lit("tests/test_f"), "p_partkey", F.lit(".py")).alias("path"))
    return src.unionByName(tests)


@query("SELECT p_brand AS project, 'src/a' || p_size || '/f' || p_partkey || '.py' AS source, 'tests/test_f' || p_partkey || '.py' AS test FROM part WHERE p_size % 2 = 0")
def test_mapping(spark, sf):
    return J.tests_of(_tree(spark, sf))


@query("""
WITH f AS (SELECT 'src/a' || p_size || '/f' || p_partkey || '.py' AS path, p_size FROM part UNION ALL SELECT 'tests/test_f' || p_partkey || '.py', NULL FROM part WHERE p_size % 2 = 0)
SELECT path, 'no_seven' AS rule FROM f WHERE p_size = 7 UNION ALL SELECT path, 'tests' FROM f WHERE p_size IS NULL
""")
def denied_files(spark, sf):
    return U.denied_files(_tree(spark, sf), {"no_seven": "src/a7/**", "tests": "**/test_*.py", "none": "src/*/x/**"})


@query("""
WITH l AS (SELECT CASE s.s_nationkey % 3 WHEN 0 THEN 'ui' WHEN 1 THEN 'core' ELSE 'db' END AS f, CASE l_partkey % 3 WHEN 0 THEN 'ui' WHEN 1 THEN 'core' ELSE 'db' END AS t, l_suppkey, l_partkey, l_linenumber
  FROM lineitem JOIN supplier s ON s_suppkey = l_suppkey)
SELECT f || '/s' || l_suppkey || '.py' AS from_file, t || '/p' || l_partkey || '.py' AS to_file, l_linenumber AS line, f AS from_layer, t AS to_layer,
  CASE WHEN f = 'db' THEN 'cannot_import' ELSE 'not_in_can_import' END AS kind FROM l WHERE (f = 'db' AND t = 'ui') OR (f = 'ui' AND t = 'db')
""")
def layer_breaches(spark, sf):
    name = lambda c: F.when(c % 3 == 0, "ui").when(c % 3 == 1, "core").otherwise("db")
    l = load(spark, sf, "lineitem").join(load(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))  # noqa: E741
    e = l.select(F.concat(name(F.col("s_nationkey")), F.lit("/s"), "l_suppkey", F.lit(".py")).alias("from_file"), F.concat(name(F.col("l_partkey")), F.lit("/p"), "l_partkey", F.lit(".py")).alias("to_file"), F.col("l_linenumber").alias("line"))
    return U.layer_breaches(e, {"ui": ["ui/**"], "core": ["core/*"], "db": ["db/**"]}, {"ui": ["core"]}, {"db": ["ui"]})


@query("""
SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'deleted' WHEN 1 THEN 'added' WHEN 2 THEN 'signature_change' ELSE 'body_change' END AS change,
  CASE WHEN n = 0 THEN 'safe' WHEN o_orderkey % 5 = 3 OR n <= 3 THEN 'low' WHEN n <= 10 THEN 'moderate' ELSE 'high' END AS risk
FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) WHERE o_orderkey % 5 < 4
""")
def signature_changes(spark, sf):
    """Two versions of every order's signature; callers are its lines."""
    k = F.col("o_orderkey") % 5
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderkey", F.lit("str").alias("returns"))
    old = o.where(k != 1).withColumn("params", F.array(F.lit("a"))).withColumn("digest", F.lit("x"))
    new = o.where(k != 0).withColumn("params", F.when(k == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).withColumn("digest", F.when(k == 4, "x").otherwise("y"))
    calls = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    return J.change_kind(old, new, "id").join(calls, "id", "left").select("id", "change", J.change_risk(F.coalesce("n", F.lit(0)), F.col("change")).alias("risk"))


@query("""
WITH c AS (SELECT l_suppkey AS id, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS covered, count(DISTINCT l_partkey) AS refs FROM lineitem GROUP BY 1)
SELECT id, total, covered, refs, round((1 - covered / total) * (1 + refs), 6) AS gap FROM c
""")
def coverage_gaps(spark, sf):
    g = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id"))
    return J.coverage_gaps(g.agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("covered"), F.countDistinct("l_partkey").alias("refs")))


@query("""
SELECT CASE WHEN path LIKE 'tests/%' THEN 'test' ELSE 'module' END AS category, regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS files
FROM (SELECT 'src/a' || p_size || '/f' || p_partkey || '.py' AS path FROM part UNION ALL SELECT 'tests/test_f' || p_partkey || '.py' FROM part WHERE p_size % 2 = 0) GROUP BY 1, 2
""")
def code_map(spark, sf):
    return K.code_map(_tree(spark, sf))


@query("""
WITH n AS (SELECT c_custkey AS id, count(o_orderkey) AS n, c_nationkey % 7 AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
b AS (SELECT id, n, k, CASE WHEN n = 0 THEN 0 WHEN n <= 3 THEN 3 WHEN n <= 10 THEN 6 ELSE 8 END + CASE WHEN n > 20 THEN 2 WHEN n > 10 THEN 1 ELSE 0 END AS b FROM n),
s AS (SELECT *, CASE WHEN k = 0 AND b > 3 THEN greatest(2, least(10, b) * 0.4) ELSE least(10, b) END AS breaking, least(0.5 * n, 5) + least(0.8 * k, 3) + least(k, 2) AS depth FROM b),
g AS (SELECT *, (CASE WHEN n > 10 THEN 1 ELSE 0 END) + (CASE WHEN breaking >= 7 THEN 1 ELSE 0 END) + (CASE WHEN depth >= 7 THEN 1 ELSE 0 END) + (CASE WHEN k > 3 THEN 1 ELSE 0 END) + (CASE WHEN k > 4 THEN 1 ELSE 0 END) + (CASE WHEN k > 5 THEN 1 ELSE 0 END) AS q FROM s)
SELECT id, round(breaking, 6) AS breaking, round(depth, 6) AS depth, CASE q WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 7 WHEN 4 THEN 8.5 ELSE least(9 + 0.5 * (q - 5), 10) END::DOUBLE AS rollback FROM g
""")
def task_risk(spark, sf):
    """Breaking, depth and rollback scores of every customer; its orders are call sites."""
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 7).alias("k"))
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    d = c.join(o, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    d = d.withColumn("breaking", V.breaking(J.change_risk(F.col("n"), F.lit("signature_change")), F.col("n"), F.col("k") == 0)).withColumn("depth", V.depth(F.col("n"), F.col("k"), F.col("k")))
    back = V.rollback(F.col("n") > 10, V.level(F.col("breaking")) == "high", V.level(F.col("depth")) == "high", F.col("k") > 3, F.col("k") > 4, F.col("k") > 5)
    return d.select("id", F.round("breaking", 6).alias("breaking"), F.round("depth", 6).alias("depth"), back.alias("rollback"))


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?is)MIT License') THEN 'MIT' WHEN regexp_matches(text, '(?is)Apache License,?\s*Version\s*2\.0') THEN 'Apache-2.0' END AS licence
FROM documents WHERE regexp_matches(text, '(?is)MIT License|Apache License,?\s*Version\s*2\.0')
""")
def licence_texts(spark, sf):
    """The first of the listed licences that a whole text names, where it is one of the first two."""
    d = load(spark, sf, "documents").select("doc_id", J.licence_of(F.col("text")).alias("licence"))
    return d.where("licence in ('MIT', 'Apache-2.0')")


@query()
def document_licences(spark, sf):
    """The first of all listed licences that a whole text names, of every document that names one."""
    return load(spark, sf, "documents").select("doc_id", J.licence_of(F.col("text")).alias("licence")).where("licence is not null")


def _functions(spark, sf):
    """Every part a function of as many lines and levels as its size tells."""
    depth = F.col("p_size") % 6
    nest = F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(F.repeat(F.lit(" "), i), F.lit("if x:")))
    nest = F.when(depth > 0, F.concat(F.array_join(nest, "\n"), F.lit("\n"))).otherwise("")
    params = F.array_join(F.slice(F.array(*[F.lit(f"a{i}") for i in range(9)]), F.lit(1), (F.col("p_partkey") % 9).cast("int")), ", ")
    calls = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") - depth + 1), lambda i: F.concat(F.repeat(F.lit(" "), depth + 1), F.lit("g()"))), "\n")
    text = F.concat(F.lit("def f("), params, F.lit("):\n"), nest, calls, F.lit("\n"), F.repeat(F.lit(" "), depth + 1), F.lit("return 1\n"))
    return dealt(load(spark, sf, "part").select("p_partkey", "p_size")).select(F.lit("p").alias("project"), F.concat(F.lit("p"), "p_partkey", F.lit(".py")).alias("path"), text.alias("text"))


@query("""
SELECT 'p' || p_partkey || '.py' AS path, 'f' AS name, p_size + 3 AS lines, p_size % 6 AS depth, p_partkey % 9 AS params, p_size % 6 AS branches,
  5 * greatest(p_size % 6 - 3, 0) + 2 * greatest(p_partkey % 9 - 5, 0) AS score FROM part
""")
def function_complexity(spark, sf):
    """Every part a function of as many lines and levels as its size tells."""
    return N.scored(N.function_metrics(_functions(spark, sf))).select("path", "name", "lines", "depth", "params", "branches", "score")
