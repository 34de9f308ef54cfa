"""Named queries over the driver's tables and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import changes as C
from tessera.operators import graph as G
from tessera.operators import history as H
from tessera.operators import intervals as I
from tessera.operators import quality as Q
from tessera.operators import search as S
from tessera.sources.tables import changes, foreign_keys, load
from tessera.streaming import sessions as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- shared SQL

TOK = r"""
tok AS (
  SELECT doc_id, lower(t) AS term FROM (
    SELECT doc_id, unnest(string_split_regex(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[ _]+')) AS t
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents)) WHERE length(t) >= 2),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
len AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY 1),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
stat AS (SELECT term, count(*) AS df FROM post GROUP BY 1)
"""
EDGES = """
edges AS (
  SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'extends' AS type FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'uses' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'uses' FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'calls' FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'calls' FROM lineitem
  UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'calls' FROM lineitem)
"""
CHG = """
chg AS (
  SELECT o_orderkey AS "commit", o_orderdate AS ts, o_custkey AS author, p_brand || '/s' || (p_size // 10) AS path, l_quantity::BIGINT AS insertions,
         floor(l_discount * 100)::BIGINT AS deletions, p_size / 5.0 AS complexity, o_orderpriority AS priority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
basket AS (
  SELECT "commit", list_sort(list_distinct(list(path))) AS paths FROM chg GROUP BY 1 HAVING count(DISTINCT path) BETWEEN 2 AND 30),
item AS (SELECT "commit", unnest(paths) AS path FROM basket)
"""
RULES = (
    CHG
    + """,
single AS (SELECT path, count(*) AS n FROM item GROUP BY 1),
pair AS (SELECT x.path AS a, y.path AS b, count(*) AS support FROM item x JOIN item y ON x."commit" = y."commit" AND x.path < y.path GROUP BY 1, 2 HAVING count(*) >= 3),
rule AS (
  SELECT a, b, support, support / p.n AS ab, support / q.n AS ba, (support / p.n + support / q.n) / 2 AS c, q.n AS nb
  FROM pair JOIN single p ON a = p.path JOIN single q ON b = q.path)
"""
)
CONFIDENCE = 0.05
PROBE = "SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)"
TERMS = ["the", "hand", "eau", "the", "para", "und"]
TERM_ROWS = "(VALUES ('the', 2), ('hand', 1), ('eau', 1), ('para', 1), ('und', 1)) q(term, qn)"

# ---------------------------------------------------------------- search


@query(f"WITH {TOK} SELECT l.doc_id, l.dl AS n_tokens, count(p.term) AS n_distinct FROM len l LEFT JOIN post p USING (doc_id) GROUP BY 1, 2")
def tokenize_stats(spark, sf):
    t = X.tokens(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"WITH {TOK} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM stat, corpus")
def bm25_term_stats(spark, sf):
    d = load(spark, sf, "documents")
    return S.term_stats(S.postings(d, "doc_id", "text"), d.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    f"WITH {TOK} SELECT doc_id, round(sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score "
    f"FROM post JOIN stat USING (term) JOIN len USING (doc_id) JOIN {TERM_ROWS} USING (term), corpus GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
)
def bm25_topk(spark, sf):
    return S.bm25(load(spark, sf, "documents"), "doc_id", "text", TERMS)


@query(
    f"""WITH {TOK}, w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM post JOIN stat USING (term), corpus),
    v AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
    q AS (SELECT DISTINCT term, 1.0 AS q FROM {TERM_ROWS})
    SELECT doc_id, round(sum(w * q), 6) AS score FROM v JOIN q USING (term) GROUP BY 1 HAVING round(sum(w * q), 6) > 0.01 ORDER BY 2 DESC, 1 LIMIT 20"""
)
def tfidf_topk(spark, sf):
    d = load(spark, sf, "documents")
    q = spark.createDataFrame([(t, 1.0) for t in sorted(set(TERMS))], "term string, q double")
    return S.cosine_topk(S.tfidf(S.postings(d, "doc_id", "text"), "doc_id", d.count()), q, "doc_id")


PMI = """
g AS (SELECT DISTINCT p_partkey AS g, lower(unnest(string_split_regex(p_name || ' ' || p_brand || ' ' || p_type, '[^A-Za-z0-9]+'))) AS term FROM part),
s AS (SELECT * FROM g WHERE length(term) >= 2),
pairs AS (SELECT a.term AS x, b.term AS y, count(*)::DOUBLE AS c FROM s a JOIN s b ON a.g = b.g AND a.term <> b.term GROUP BY 1, 2),
z AS (SELECT sum(c) AS z FROM pairs), f AS (SELECT x, sum(c) AS f FROM pairs GROUP BY 1),
v AS (SELECT p.x, p.y, round(ln(((c + 0.1) / z) / ((a.f / z) * (b.f / z) + 1e-10)), 6) AS pmi FROM pairs p JOIN f a ON p.x = a.x JOIN f b ON p.y = b.x, z WHERE a.f >= 2 AND b.f >= 2),
top AS (SELECT * FROM v WHERE pmi > 0 QUALIFY row_number() OVER (PARTITION BY x ORDER BY pmi DESC, y) <= 15)
"""


def _related(spark, sf):
    words = F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), "[^A-Za-z0-9]+")
    g = load(spark, sf, "part").select(F.col("p_partkey").alias("g"), F.explode(F.array_distinct(F.transform(words, F.lower))).alias("term")).where(F.length("term") >= 2)
    return S.pmi(S.cooccurrence(g, "g"))


@query(f"WITH {PMI} SELECT x, y, pmi FROM top")
def pmi_top15(spark, sf):
    return _related(spark, sf)


@query(f"WITH {PMI} SELECT y AS term, round(sum(pmi), 6) AS score FROM top WHERE x IN ('steel', 'brand', 'small') AND y NOT IN ('steel', 'brand', 'small') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def concept_expand(spark, sf):
    return S.expand(_related(spark, sf), ["steel", "brand", "small"])


VEC = f"""
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS p FROM ({PROBE})),
near AS (SELECT vec_id, round(list_dot_product(e, p) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(p, p))), 6) AS score FROM v, q ORDER BY 2 DESC, 1 LIMIT 20)
"""


def _near(spark, sf):
    e = load(spark, sf, "embeddings")
    first = e.orderBy("vec_id").select("embedding").first()
    return S.vector_topk(e, "vec_id", "embedding", [float(x) for x in first[0]])


@query(f"WITH {VEC} SELECT * FROM near")
def vector_topk(spark, sf):
    return _near(spark, sf)


@query(
    f"""WITH {VEC}, lab AS (SELECT vec_id, round(1.0 / (1 + label), 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20),
    a AS (SELECT vec_id, 0.7 / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) AS a FROM near),
    b AS (SELECT vec_id, (1 - 0.7) / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) AS b FROM lab)
    SELECT vec_id, round(coalesce(a, 0) + coalesce(b, 0), 8) AS score FROM a FULL JOIN b USING (vec_id) ORDER BY 2 DESC, 1 LIMIT 20"""
)
def hybrid_rrf(spark, sf):
    by_label = load(spark, sf, "embeddings").select("vec_id", F.round(1.0 / (1 + F.col("label")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)
    return S.fuse(_near(spark, sf), by_label, "vec_id")


@query(
    """WITH s AS (SELECT p_partkey, p_name, lower(p_name) AS l, 1 - levenshtein(lower(p_name), 'small part 12') / greatest(length(p_name), 13) AS near FROM part)
    SELECT p_partkey, p_name, round(CASE WHEN l = 'small part 12' THEN 30.0 ELSE 0 END + CASE WHEN contains(l, 'small part 12') THEN 10.0 ELSE 0 END + near * 15, 6) AS score
    FROM s WHERE near >= 0.6 OR contains(l, 'small part 12')"""
)
def fuzzy_rank(spark, sf):
    return S.fuzzy(load(spark, sf, "part"), "p_partkey", "p_name", "small part 12")


@query(f"WITH {TOK}, hit AS (SELECT DISTINCT doc_id FROM tok WHERE term IN ('the', 'und')) SELECT quality, count(*) AS n, count(h.doc_id) AS hits FROM labels LEFT JOIN hit h USING (doc_id) GROUP BY 1")
def eval_hits_by_quality(spark, sf):
    hit = load(spark, sf, "documents").where(F.arrays_overlap(X.tokens(F.col("text")), F.array(F.lit("the"), F.lit("und")))).select("doc_id", F.lit(1).alias("hit"))
    return load(spark, sf, "labels").join(hit, "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))


# ---------------------------------------------------------------- graph


@query(f"WITH {EDGES} SELECT target AS symbol_id, count(DISTINCT source) AS refs FROM edges GROUP BY 1")
def reference_counts(spark, sf):
    return G.reference_counts(foreign_keys(spark, sf))


@query(f"WITH {EDGES} SELECT DISTINCT target AS symbol_id, source AS caller_id FROM edges")
def reverse_index(spark, sf):
    return G.reverse_index(foreign_keys(spark, sf))


@query(f"WITH RECURSIVE {EDGES}, r(id, d) AS (SELECT 'region:0', 0 UNION SELECT source, d + 1 FROM r JOIN edges ON target = id WHERE d < 3) SELECT id, min(d)::INT AS level FROM r GROUP BY 1")
def impact_bfs(spark, sf):
    return G.impact(foreign_keys(spark, sf), "region:0", 3)


@query(f"WITH {EDGES} SELECT split_part(source, ':', 1) AS from_kind, split_part(target, ':', 1) AS to_kind, type, count(*) AS n FROM edges GROUP BY ALL")
def dependency_summary(spark, sf):
    kind = lambda c: F.substring_index(c, ":", 1)
    return foreign_keys(spark, sf).groupBy(kind("source").alias("from_kind"), kind("target").alias("to_kind"), "type").agg(F.count("*").alias("n"))


@query(
    """SELECT 'customer:' || c_custkey AS start, ['customer:' || c_custkey, 'nation:' || c_nationkey, 'region:' || n_regionkey] AS path, 'leaf' AS ended
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def trace_down(spark, sf):
    starts = load(spark, sf, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return G.simple_paths(foreign_keys(spark, sf).where("type <> 'calls'").select("source", "target"), starts, depth=3)


@query("""
SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'order:' || o_orderkey FROM orders UNION ALL
SELECT 'part:' || p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)
""")
def dead_symbols(spark, sf):
    """Customers, orders, parts and suppliers that nothing refers to; orders begin everything."""
    nodes = None
    for table, column in (("customer", "c_custkey"), ("order", "o_orderkey"), ("part", "p_partkey"), ("supplier", "s_suppkey")):
        rows = load(spark, sf, "orders" if table == "order" else table).select(F.concat(F.lit(f"{table}:"), F.col(column).cast("string")).alias("id"))
        nodes = rows if nodes is None else nodes.union(rows)
    return G.orphans(nodes, foreign_keys(spark, sf))


TRADE = """trade AS (SELECT DISTINCT cn.n_name AS source, sn.n_name AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey)"""


def _trade(spark, sf):
    t = lambda n: load(spark, sf, n)
    li = t("lineitem").select("l_orderkey", "l_suppkey")
    c = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("cn"))
    s = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("sn"))
    e = li.join(c, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("cn", "sn").distinct()
    n = t("nation").select("n_nationkey", "n_name")
    e = e.join(n.select(F.col("n_nationkey").alias("cn"), F.col("n_name").alias("source")), "cn").join(n.select(F.col("n_nationkey").alias("sn"), F.col("n_name").alias("target")), "sn")
    return e.select("source", "target")


@query(f"WITH {TRADE} SELECT a.source AS a, a.target AS b FROM trade a JOIN trade b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target")
def two_cycles(spark, sf):
    return G.two_cycles(_trade(spark, sf))


@query(
    f"WITH {TRADE}, reg AS (SELECT n_name AS id, r_name AS layer FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT f.layer AS from_layer, t.layer AS to_layer, count(*) AS n "
    "FROM trade JOIN reg f ON source = f.id JOIN reg t ON target = t.id WHERE f.layer <> t.layer AND (f.layer, t.layer) NOT IN (('ASIA', 'EUROPE'), ('EUROPE', 'ASIA')) GROUP BY 1, 2"
)
def layer_violations(spark, sf):
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    layers = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("id"), F.col("r_name").alias("layer"))
    allowed = spark.createDataFrame([("ASIA", "EUROPE"), ("EUROPE", "ASIA")], "from_layer string, to_layer string")
    return C.layer_violations(_trade(spark, sf), layers, allowed)


@query(
    """SELECT r_name AS project, count(DISTINCT o_orderkey) AS callers, count(DISTINCT cn.n_regionkey) AS caller_projects
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region ON sn.n_regionkey = r_regionkey WHERE cn.n_regionkey <> sn.n_regionkey GROUP BY 1"""
)
def cross_project_impact(spark, sf):
    t = lambda n: load(spark, sf, n)
    n = t("nation").select("n_nationkey", "n_regionkey")
    c = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", F.col("n_regionkey").alias("cr"))
    s = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("n_regionkey").alias("sr"), F.col("r_name").alias("project"))
    j = t("lineitem").select("l_orderkey", "l_suppkey").join(c, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("cr <> sr")
    return j.groupBy("project").agg(F.countDistinct("o_orderkey").alias("callers"), F.countDistinct("cr").alias("caller_projects"))


@query(
    """WITH m AS (SELECT DISTINCT user_id, event_type FROM events) SELECT user_id AS owner, 'buyer' AS interface FROM m WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1 HAVING count(*) = 3
    UNION ALL SELECT user_id, 'member' FROM m WHERE event_type IN ('signup', 'view') GROUP BY 1 HAVING count(*) = 2"""
)
def implements_division(spark, sf):
    need = spark.createDataFrame([("buyer", "view"), ("buyer", "click"), ("buyer", "purchase"), ("member", "signup"), ("member", "view")], "interface string, method string")
    return G.implements(load(spark, sf, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("method")), need)


@query(
    """WITH e AS (SELECT event_id, event_type || '/' || user_id AS exact, event_type AS loose FROM events),
    a AS (SELECT event_type || '/' || user_id AS name, min(event_id) AS target FROM events WHERE event_type = 'signup' GROUP BY 1),
    b AS (SELECT event_type AS name, min(event_id) AS target FROM events WHERE event_type <> 'error' GROUP BY 1)
    SELECT event_id, coalesce(a.target, b.target) AS target, CASE WHEN a.target IS NOT NULL THEN 0 WHEN b.target IS NOT NULL THEN 1 END::INT AS stage
    FROM e LEFT JOIN a ON exact = a.name LEFT JOIN b ON loose = b.name"""
)
def resolution_cascade(spark, sf):
    e = load(spark, sf, "events")
    exact = F.concat_ws("/", "event_type", F.col("user_id").cast("string"))
    a = e.where("event_type = 'signup'").groupBy(exact.alias("name")).agg(F.min("event_id").alias("target"))
    b = e.where("event_type <> 'error'").groupBy(F.col("event_type").alias("name")).agg(F.min("event_id").alias("target"))
    first = e.select("event_id", exact.alias("name")).join(a, "name").select("event_id", "target")
    second = e.select("event_id", F.col("event_type").alias("name")).join(F.broadcast(b), "name").select("event_id", "target")  # one row an event type
    return G.first_resolved(e, "event_id", [first, second])


@query(
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages), n AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS url FROM l)
    SELECT url, count(*) AS links, count(DISTINCT page_id) AS pages FROM n WHERE url <> '' GROUP BY 1"""
)
def api_calls(spark, sf):
    l = load(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("url"))  # noqa: E741
    return l.select("page_id", X.normalised_url(F.col("url")).alias("url")).where("url <> ''").groupBy("url").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


@query(
    r"""WITH d AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '/+$', '') AS url FROM pages),
    c AS (SELECT regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), '/+$', '') AS url, page_id FROM pages), k AS (SELECT url, count(*) AS calls FROM c GROUP BY 1)
    SELECT coalesce(d.url, k.url) AS url, d.url IS NOT NULL AS defined, coalesce(calls, 0) AS calls FROM d FULL JOIN k ON d.url = k.url"""
)
def list_apis(spark, sf):
    p = load(spark, sf, "pages")
    d = p.select(X.normalised_url(F.regexp_replace("url", "^[a-z]+://[^/]+", "")).alias("url")).distinct().withColumn("d", F.lit(True))
    k = p.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("url")).select(F.regexp_replace("url", "/+$", "").alias("url")).groupBy("url").agg(F.count("*").alias("calls"))
    return d.join(k, "url", "full_outer").select("url", F.coalesce("d", F.lit(False)).alias("defined"), F.coalesce("calls", F.lit(0)).alias("calls"))


@query(
    """WITH t AS (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) SELECT role, next, count(*) AS n FROM t WHERE next IS NOT NULL GROUP BY 1, 2"""
)
def turn_graph(spark, sf):
    from pyspark.sql import Window as W

    t = load(spark, sf, "conversations").select("role", F.lead("role").over(W.partitionBy("conv_id").orderBy("turn")).alias("next"))
    return t.where("next is not null").groupBy("role", "next").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- history


@query(
    f"""WITH {CHG}, per AS (SELECT path, author, count(*) AS n FROM chg GROUP BY 1, 2),
    who AS (SELECT path, sum(n)::BIGINT AS commits, count(*) AS authors, arg_min(author, (-n, author)) AS primary_author FROM per GROUP BY 1), cx AS (SELECT path, max(complexity) AS complexity FROM chg GROUP BY 1)
    SELECT path, commits, authors, primary_author, complexity::DOUBLE AS complexity, round(commits * (1 + complexity::DOUBLE / 10), 6) AS score FROM who JOIN cx USING (path)"""
)
def hotspots(spark, sf):
    c = changes(spark, sf)
    return H.hotspots(c, c.groupBy("path").agg(F.max("complexity").cast("double").alias("complexity")))


@query(f"WITH {RULES} SELECT a, b, support, round(ab, 6) AS conf_ab, round(ba, 6) AS conf_ba, round(c, 6) AS confidence, round(c / (nb / (SELECT count(*) FROM basket)), 6) AS lift FROM rule WHERE c >= {CONFIDENCE}")
def assoc_rules(spark, sf):
    return H.rules(changes(spark, sf), min_confidence=CONFIDENCE)


@query(
    f"""WITH RECURSIVE {RULES}, e AS (SELECT a, b FROM rule WHERE c >= 0.07 UNION SELECT b, a FROM rule WHERE c >= 0.07),
    r(id, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT b, root FROM r JOIN e ON a = id) SELECT id, min(root) AS root FROM r GROUP BY 1"""
)
def change_clusters(spark, sf):
    return G.components(H.rules(changes(spark, sf), min_confidence=0.07).select("a", "b"))


TARGET = "(SELECT min(path) FROM chg)"


def _target(c: DataFrame) -> str:
    return c.agg(F.min("path")).first()[0]


@query(
    f"""WITH {CHG}, mine AS (SELECT DISTINCT "commit" FROM chg WHERE path = {TARGET}) SELECT path, count(DISTINCT "commit") AS together, round(count(DISTINCT "commit") / (SELECT count(*) FROM mine), 6) AS ratio
    FROM chg JOIN mine USING ("commit") WHERE path <> {TARGET} GROUP BY 1 HAVING count(DISTINCT "commit") >= 2"""
)
def cochange(spark, sf):
    c = changes(spark, sf)
    return H.cochange(c, _target(c))


@query(
    f"""WITH {CHG}, mine AS (SELECT DISTINCT "commit" FROM chg WHERE path = {TARGET}) SELECT path, round(count(DISTINCT "commit") / (SELECT count(*) FROM mine), 6) AS confidence
    FROM chg JOIN mine USING ("commit") WHERE path <> {TARGET} GROUP BY 1 HAVING round(count(DISTINCT "commit") / (SELECT count(*) FROM mine), 6) >= 0.03"""
)
def suggest_cochanges(spark, sf):
    c = changes(spark, sf)
    return H.suggest(c, [_target(c)], 0.03)


@query(f'WITH {CHG} SELECT path, count(DISTINCT "commit") AS commits, count(DISTINCT author) AS authors, sum(insertions)::BIGINT AS inserted, sum(deletions)::BIGINT AS deleted, (sum(insertions) + sum(deletions))::BIGINT AS total FROM chg GROUP BY 1')
def churn(spark, sf):
    return H.churn(changes(spark, sf))


@query(
    f"""WITH {CHG}, g AS (SELECT "commit", count(DISTINCT path) AS files, bool_or(priority LIKE '1-%') AS risky, sum(insertions + deletions)::BIGINT AS lines, bool_or(complexity > 5) AS cx FROM chg GROUP BY 1)
    SELECT "commit", files, lines, (2 * greatest(files - 5, 0) + CASE WHEN risky THEN 3 ELSE 0 END + lines // 100 + CASE WHEN cx THEN 2 ELSE 0 END)::BIGINT AS risk FROM g"""
)
def risk_commits(spark, sf):
    return H.risk(changes(spark, sf), F.col("priority").startswith("1-"))


AGE = "age AS (SELECT o_custkey AS id, count(*) AS refs, date_diff('day', max(o_orderdate)::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) AS age FROM orders GROUP BY 1)"


def _ages(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    newest = o.agg(F.max("d")).first()[0]
    return o.groupBy("id").agg(F.count("*").alias("refs"), F.max("d").alias("d")).select("id", "refs", F.datediff(F.lit(newest), "d").cast("long").alias("age"))


@query(f"WITH {AGE} SELECT id, refs, age, refs * age AS rank_score FROM age WHERE refs >= 3 AND age >= 180")
def stale_symbols(spark, sf):
    return H.stale(_ages(spark, sf))


@query(f"WITH {AGE} SELECT CASE WHEN age <= 30 THEN 'fresh' WHEN age <= 90 THEN 'recent' WHEN age <= 180 THEN 'aging' ELSE 'stale' END AS band, count(*) AS n FROM age GROUP BY 1")
def freshness_bands(spark, sf):
    return _ages(spark, sf).groupBy(H.freshness(F.col("age")).alias("band")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- lines of documents

LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)"
CHUNKS = rf"""{LINES}, r AS (SELECT doc_id, line, trim(regexp_replace(s, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS s FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i FROM r WHERE s <> ''),
w AS (SELECT doc_id, line AS start, string_agg(s, chr(10)) OVER o AS run, count(*) OVER o AS n FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
chunk AS (SELECT doc_id, start, md5(run) AS hash FROM w WHERE n = 6)"""


def _chunks(spark, sf):
    return Q.chunks(load(spark, sf, "documents"), "doc_id", "text", 6)


@query(f"WITH {CHUNKS} SELECT hash, count(*) AS copies, count(DISTINCT doc_id) AS files, min(doc_id) AS first_file, arg_min(start, (doc_id, start))::INT AS first_line FROM chunk GROUP BY 1 HAVING count(*) > 1")
def duplicate_blocks(spark, sf):
    return Q.duplicate_blocks(_chunks(spark, sf), "doc_id")


@query(f"WITH {CHUNKS}, g AS (SELECT hash, count(*) AS n FROM chunk GROUP BY 1) SELECT sum(n)::BIGINT AS chunks, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicated, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS rate FROM g")
def duplicate_rate(spark, sf):
    return Q.duplicate_rate(_chunks(spark, sf), 6)


REGIONS = CHUNKS.replace("line AS start,", "line AS start, max(line) OVER o AS last,").replace("SELECT doc_id, start, md5(run)", "SELECT doc_id, start, last, md5(run)")


@query(f"""WITH {REGIONS}, g AS (SELECT hash FROM chunk GROUP BY 1 HAVING count(*) > 1), d AS (SELECT DISTINCT doc_id, start, last FROM chunk SEMI JOIN g USING (hash)),
e AS (SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY start, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
f AS (SELECT *, sum(CASE WHEN start - reach <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, last) AS region FROM e)
SELECT doc_id, min(start)::INT AS start, max(last)::INT AS "end" FROM f GROUP BY doc_id, region""")
def duplicated_regions(spark, sf):
    return Q.duplicated_regions(_chunks(spark, sf), "doc_id")


PATTERNS = {"email": r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[a-z]+", "token": r"(token|key|secret|password) *= *\"", "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "license": r"(?i)(license|copyright|all rights reserved)"}


@query("WITH " + LINES + ", p AS (" + " UNION ALL ".join(f"SELECT doc_id, line, '{k}' AS rule FROM l WHERE regexp_matches(s, '{v}')" for k, v in PATTERNS.items()) + ") SELECT doc_id, line::INT AS line, rule FROM p")
def grep_rules(spark, sf):
    return Q.scan(load(spark, sf, "documents"), "doc_id", "text", PATTERNS).select("doc_id", "line", "rule")


@query(f"""WITH {LINES} SELECT doc_id, line::INT AS line, regexp_replace(s, '"([^"]{{4}})[^"]*"', '"\\1****"', 'g') AS shown FROM l WHERE regexp_matches(s, '{PATTERNS["token"]}')""")
def secret_scan_masked(spark, sf):
    return Q.scan(load(spark, sf, "documents"), "doc_id", "text", {"token": PATTERNS["token"]}).select("doc_id", "line", Q.masked(F.col("content")).alias("shown"))


@query(
    "WITH " + LINES + ", p AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule FROM l WHERE regexp_matches(s, '{v}')" for k, v in PATTERNS.items()) + """)
    SELECT lang, rule, count(*) AS n FROM p JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang, rule), (lang), (rule), ())"""
)
def marker_counts(spark, sf):
    d = load(spark, sf, "documents")
    hits = Q.scan(d.select("doc_id", "lang", "text"), "lang", "text", PATTERNS)
    return hits.groupingSets([["lang", "rule"], ["lang"], ["rule"], []], "lang", "rule").agg(F.count("*").alias("n"))


CPLX = r"""cx AS (SELECT doc_id, source, len(string_split(text, chr(10))) AS lines, (length(text) - length(replace(text, ',', ''))) AS commas,
  list_max(list_transform(string_split(text, chr(10)), lambda x: len(string_split(x, '. ')))) AS depth FROM documents),
sc AS (SELECT doc_id, source, lines, (CASE WHEN lines > 80 THEN (lines - 80) // 10 ELSE 0 END + 5 * greatest(depth - 3, 0) + greatest(commas - 10, 0))::BIGINT AS score FROM cx)"""


def _complexity(spark, sf):
    d = load(spark, sf, "documents")
    ls = X.lines(F.col("text"))
    depth = F.array_max(F.transform(ls, lambda x: F.size(F.split(x, r"\. ", -1))))
    commas = F.length("text") - F.length(F.replace("text", F.lit(","), F.lit("")))
    return d.select("doc_id", "source", F.size(ls).cast("long").alias("lines"), Q.complexity(F.size(ls), depth, F.lit(0), commas).cast("long").alias("score"))


@query(f"WITH {CPLX} SELECT doc_id, source, lines, score FROM sc")
def complexity_score(spark, sf):
    return _complexity(spark, sf)


@query(
    f"""WITH {CPLX}, p AS (SELECT source, avg((score > 100)::INT) AS c, avg((lines < 2)::INT) AS d, avg((lines > 3)::INT) AS m, avg((score > 0)::INT) AS r FROM sc GROUP BY 1),
    h AS (SELECT source, round(greatest(0, least(25, 25 - 100 * c)) + greatest(0, least(25, 25 - 100 * d)) + greatest(0, least(25, 25 * m / 0.7)) + greatest(0, least(25, 25 * r)), 6) AS score FROM p)
    SELECT source, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM h"""
)
def health_score(spark, sf):
    share = lambda c: F.avg(F.expr(c).cast("int"))
    p = _complexity(spark, sf).groupBy("source").agg(share("score > 100").alias("c"), share("lines < 2").alias("d"), share("lines > 3").alias("m"), share("score > 0").alias("r"))
    s = p.select("source", F.round(Q.health(F.col("c"), F.col("d"), F.col("m"), F.col("r")), 6).alias("score"))
    return s.withColumn("grade", Q.grade(F.col("score")))


@query(
    f"""WITH {CPLX} SELECT doc_id, 'complex' AS kind, CASE WHEN score >= 200 THEN 'high' ELSE 'medium' END AS priority, score FROM sc WHERE score >= 100
    UNION ALL SELECT doc_id, 'large', 'medium', lines FROM sc WHERE lines > 20"""
)
def refactor_suggestions(spark, sf):
    c = _complexity(spark, sf)
    a = c.where("score >= 100").select("doc_id", F.lit("complex").alias("kind"), F.when(F.col("score") >= 200, "high").otherwise("medium").alias("priority"), "score")
    return a.union(c.where("lines > 20").select("doc_id", F.lit("large"), F.lit("medium"), "lines"))


@query(
    r"""WITH n AS (SELECT unnest(string_split_regex(p_name || ' ' || p_brand || ' ' || p_type, ' +')) AS name FROM part)
    SELECT CASE WHEN regexp_matches(name, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$') THEN 'UPPER_SNAKE' WHEN regexp_matches(name, '^[A-Z][a-z0-9]+([A-Z][a-z0-9]*)*$') THEN 'PascalCase'
      WHEN regexp_matches(name, '^[a-z]+[a-z0-9]*([A-Z][a-z0-9]*)+$') THEN 'camelCase' WHEN regexp_matches(name, '^[a-z][a-z0-9]*(_[a-z0-9]+)+$') THEN 'snake_case'
      WHEN regexp_matches(name, '^[a-z][a-z0-9]*(-[a-z0-9]+)+$') THEN 'kebab-case' WHEN regexp_matches(name, '^[a-z][a-z0-9]*$') THEN 'lowercase' ELSE 'other' END AS style, count(*) AS n FROM n GROUP BY 1"""
)
def naming_styles(spark, sf):
    n = load(spark, sf, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " +")).alias("name"))
    return n.groupBy(X.naming_style(F.col("name")).alias("style")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- intervals

DAYS = "d AS (SELECT user_id AS key, date_diff('day', DATE '1970-01-01', ts::DATE) AS point, event_type FROM events), span AS (SELECT key, min(point) AS s, max(point) AS e FROM d GROUP BY 1)"


def _days(spark, sf):
    return load(spark, sf, "events").select(F.col("user_id").alias("key"), F.unix_date(F.col("ts").cast("date")).cast("long").alias("point"), "event_type")


def _spans(d):
    return d.groupBy("key").agg(F.min("point").alias("start"), F.max("point").alias("end"))


ISLANDS = """, p AS (SELECT DISTINCT key, point FROM {0}), g AS (SELECT *, point - row_number() OVER (PARTITION BY key ORDER BY point) AS g FROM p)
SELECT key, min(point) AS start, max(point) AS "end", count(*) AS n FROM g GROUP BY key, g"""


@query(f"WITH {DAYS}" + ISLANDS.format("d"))
def active_ranges(spark, sf):
    return I.ranges(_days(spark, sf), "key", "point")


MISS = ", every AS (SELECT key, unnest(range(s, e + 1)) AS point FROM span), hit AS (SELECT DISTINCT key, point FROM d WHERE event_type IN ('view', 'click')), miss AS (SELECT key, point FROM every EXCEPT SELECT key, point FROM hit)"


@query(f"WITH {DAYS}{MISS}" + ISLANDS.format("miss"))
def uncovered_ranges(spark, sf):
    d = _days(spark, sf)
    return I.uncovered(_spans(d), d.where("event_type in ('view', 'click')").select("key", "point"), "key")


@query(f"WITH {DAYS}{MISS} SELECT key, count(*) AS total, count(h.point) AS covered, round(100 * count(h.point) / count(*), 6) AS pct FROM every LEFT JOIN hit h USING (key, point) GROUP BY 1")
def coverage_pct(spark, sf):
    d = _days(spark, sf)
    return I.coverage(_spans(d), d.where("event_type in ('view', 'click')").select("key", "point"), "key")


@query(
    f"""WITH {DAYS}, a AS (SELECT DISTINCT key, point AS s, point + 2 AS e FROM d WHERE event_type = 'purchase'), b AS (SELECT DISTINCT key, point AS s, point + 1 AS e FROM d WHERE event_type = 'error')
    SELECT key, a.s AS start, a.e AS "end", b.s AS b_start, b.e AS b_end FROM a JOIN b USING (key) WHERE a.s <= b.e AND b.s <= a.e"""
)
def interval_overlap(spark, sf):
    d = _days(spark, sf)
    hunk = lambda kind, n: d.where(F.col("event_type") == kind).select("key", F.col("point").alias("start"), (F.col("point") + n).alias("end")).distinct()
    return I.overlaps(hunk("purchase", 2), hunk("error", 1), "key")


@query(f"WITH {DAYS} SELECT DISTINCT key, point FROM d WHERE event_type = 'purchase' EXCEPT SELECT key, point FROM d WHERE event_type = 'view'")
def untested_changes(spark, sf):
    d = _days(spark, sf)
    return d.where("event_type = 'purchase'").select("key", "point").distinct().join(d.where("event_type = 'view'").select("key", "point"), ["key", "point"], "left_anti")


# ---------------------------------------------------------------- versions and contracts

OLD = "old AS (SELECT doc_id, substr(sha256(text), 1, 16) AS h FROM documents WHERE NOT (lang = 'es')), new AS (SELECT doc_id, substr(sha256(CASE WHEN lang = 'fr' THEN text || '!' ELSE text END), 1, 16) AS h FROM documents WHERE NOT (lang = 'de'))"


def _versions(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "lang", "text")
    new = d.where("lang <> 'de'").withColumn("text", F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    digest = lambda x: x.select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("h"))
    return digest(d.where("lang <> 'es'")), digest(new), new


@query(f"WITH {OLD} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM old o FULL JOIN new n USING (doc_id) WHERE o.h IS DISTINCT FROM n.h")
def detect_changes(spark, sf):
    old, new, _ = _versions(spark, sf)
    return C.detect_changes(old, new, "doc_id", "h")


@query(f"WITH {TOK} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM post JOIN documents USING (doc_id) WHERE lang <> 'de' GROUP BY 1")
def incremental_postings(spark, sf):
    """Postings of the new version kept up to date from the old one's; the twin rebuilds them."""
    d = load(spark, sf, "documents")
    old, new, texts = _versions(spark, sf)
    ch = C.detect_changes(old, new, "doc_id", "h")
    fresh = S.postings(texts.join(ch.where("change <> 'deleted'").select("doc_id"), "doc_id", "left_semi"), "doc_id", "text")
    kept = C.update_postings(S.postings(d.where("lang <> 'es'"), "doc_id", "text"), ch, fresh, "doc_id")
    return kept.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


PRODUCER = [("order", "id", "int", False), ("order", "total", "float", False), ("order", "note", "str", True), ("user", "name", "str", True)]
CONSUMER = [("order", "id", "str", False), ("order", "total", "float", False), ("user", "name", "str", False), ("user", "age", "int", False)]
VALUES = lambda rows: ", ".join(f"('{a}', '{b}', '{c}', {str(d).lower()})" for a, b, c, d in rows)


@query(
    f"""WITH p(model, field, type, optional) AS (VALUES {VALUES(PRODUCER)}), c(model, field, type, optional) AS (VALUES {VALUES(CONSUMER)}),
    j AS (SELECT coalesce(p.model, c.model) AS model, coalesce(p.field, c.field) AS field, CASE WHEN c.type IS NULL THEN 'missing_in_consumer' WHEN p.type IS NULL THEN 'missing_in_producer'
      WHEN p.type <> c.type THEN 'type_mismatch' WHEN p.optional AND NOT c.optional THEN 'optionality_mismatch' END AS issue FROM p FULL JOIN c ON p.model = c.model AND p.field = c.field)
    SELECT model, field, issue, CASE issue WHEN 'missing_in_consumer' THEN 'info' WHEN 'optionality_mismatch' THEN 'warning' ELSE 'error' END AS severity FROM j WHERE issue IS NOT NULL"""
)
def schema_diff(spark, sf):
    s = "model string, field string, type string, optional boolean"
    return C.compare_schemas(spark.createDataFrame(PRODUCER, s), spark.createDataFrame(CONSUMER, s))


# ---------------------------------------------------------------- risk and budget

RISK = """b AS (SELECT s_suppkey AS id, count(DISTINCT l_orderkey) AS n, count(DISTINCT c_nationkey) AS projects FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1)"""


@query(
    f"""WITH {RISK}, s AS (SELECT id, n, projects, round(CASE WHEN n = 0 THEN 0 WHEN n <= 3 THEN 2 WHEN n <= 10 THEN 4 + 0.3 * (n - 4) WHEN n <= 20 THEN 6 + 0.2 * (n - 11) WHEN n <= 50 THEN 8 + 0.07 * (n - 21) ELSE 10 END, 6)::DOUBLE AS blast,
      CASE WHEN projects <= 1 THEN 0.0 WHEN projects <= 3 THEN 4.0 WHEN projects <= 10 THEN 7.0 ELSE 9.0 END::DOUBLE AS coupling FROM b)
    SELECT id, n, projects, blast, coupling, CASE WHEN greatest(blast, coupling) >= 8 THEN 'high' WHEN greatest(blast, coupling) >= 5 THEN 'moderate' WHEN greatest(blast, coupling) >= 2 THEN 'low' ELSE 'safe' END AS overall FROM s"""
)
def risk_dimensions(spark, sf):
    from tessera.plans.risk import blast_radius, coupling, overall

    t = lambda n: load(spark, sf, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    s = t("supplier").select("s_suppkey")
    j = t("lineitem").select("l_orderkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    b = j.groupBy(F.col("s_suppkey").alias("id")).agg(F.countDistinct("l_orderkey").alias("n"), F.countDistinct("c_nationkey").alias("projects"))
    b = b.withColumn("blast", F.round(blast_radius(F.col("n")), 6)).withColumn("coupling", coupling(F.col("projects")))
    return b.withColumn("overall", overall(F.greatest("blast", "coupling")))


@query(
    """WITH t AS (SELECT source, doc_id, greatest(1, n_chars // 3) AS tokens FROM documents), r AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY tokens, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM t)
    SELECT source, doc_id, tokens, used FROM r WHERE used <= 4000"""
)
def context_budget(spark, sf):
    from tessera.plans.risk import within_budget

    d = load(spark, sf, "documents").select("source", "doc_id", F.greatest(F.lit(1), F.expr("n_chars div 3")).alias("tokens"))
    return within_budget(d, "source", ["tokens", "doc_id"], "tokens", 4000)


# ---------------------------------------------------------------- event streams


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 24 HOUR THEN 1 ELSE 0 END AS new, event_id FROM events),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s"""
)
def sessionize(spark, sf):
    e = load(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return E.sessions(e, "user_id", "ts").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(
    """SELECT event_id, user_id, count(*) OVER w AS recent, count(*) OVER w > 2 AS limited FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)"""
)
def rate_limited(spark, sf):
    e = load(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return E.over_limit(e, "user_id", "ts", limit=2, seconds=3600).select("event_id", "user_id", "recent", "limited")


@query(
    """WITH l AS (SELECT user_id, event_type, max(ts) AS last_ts FROM events GROUP BY 1, 2) SELECT user_id, event_type, last_ts, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, event_type)::INT AS rank
    FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, event_type) <= 3"""
)
def recently_used(spark, sf):
    return E.recently_used(load(spark, sf, "events"), "user_id", "event_type", "ts", 3)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf):
    e = load(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return E.tumbling(e, "ts", "1 day", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT c_mktsegment AS project, count(*) AS symbols, count(DISTINCT c_nationkey) AS files FROM customer GROUP BY 1")
def list_projects(spark, sf):
    return load(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("project")).agg(F.count("*").alias("symbols"), F.countDistinct("c_nationkey").alias("files"))
