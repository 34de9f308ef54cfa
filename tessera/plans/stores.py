"""Queries over stored indexes: generations that are refreshed, blocks of weights that are read in part."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.shared import folder
from tessera.functions.text import tokens
from tessera.operators import blocks as B
from tessera.operators import search as S
from tessera.plans.projects import SQL, project_files
from tessera.plans.registry import PMI, TOK, _related, query
from tessera.sources import generations as G
from tessera.sources.tables import load


def edited_files(spark, sf):
    """The projects after a day of work, all files that there are now.

    Programs of every fourth customer call a helper of the library too, every
    second library renames a function, core.py moves in a third of the
    nations, misc.py goes in another third, a fifth gets a second ``only``.
    """
    f = project_files(spark, sf)
    n, k = F.regexp_extract("project", r"(\d+)", 1).cast("long"), F.regexp_extract("path", r"(\d+)\.py$", 1).cast("long")
    app, lib = F.col("path").startswith("app/"), F.col("path").startswith("lib/")
    helper = F.regexp_extract("text", r"from s(\d+) import", 1)
    text = F.when(app & (k % 4 == 0), F.concat("text", F.lit("    near"), helper, F.lit("(5)\n"))).when(lib & (k % 2 == 0), F.replace("text", F.lit("def help"), F.lit("def aid"))).otherwise(F.col("text"))
    path = F.when((F.col("path") == "core.py") & (n % 3 == 1), "core2.py").otherwise(F.col("path"))
    kept = f.where(~((F.col("path") == "misc.py") & (n % 3 == 2))).select("project", path.alias("path"), text.alias("text"))
    nation = load(spark, sf, "nation").where("n_nationkey % 5 = 0")
    more = nation.select(F.concat(F.lit("p"), "n_nationkey"), F.lit("extra.py"), F.concat(F.lit("def only"), "n_nationkey", F.lit("(x):\n    return x\n")))
    return kept.union(more)


@query(
    SQL
    + """
, lib AS (SELECT s_suppkey AS s, s_nationkey AS n, 'lib/s' || s_suppkey || '.py' AS path, CASE s_suppkey % 2 WHEN 0 THEN 'aid' ELSE 'help' END AS f FROM supplier)
SELECT 'p' || n AS project, 'app/c' || k || '.py:function:run' || k AS source, t AS target, found, CASE WHEN found IS NOT NULL THEN stage END AS stage FROM (
  SELECT n, k, 'help' || s AS t, CASE s % 2 WHEN 1 THEN 'lib/s' || s || '.py:function:help' || s END AS found, 'import' AS stage FROM c UNION ALL
  SELECT n, k, 'deep' || n, CASE n % 3 WHEN 1 THEN 'core2.py' ELSE 'core.py' END || ':function:deep' || n, CASE n % 3 WHEN 1 THEN 'global' ELSE 're_export' END FROM c UNION ALL
  SELECT n, k, 'only' || n, CASE WHEN n % 3 = 2 AND n % 5 = 0 THEN 'extra.py' WHEN n % 3 <> 2 AND n % 5 <> 0 THEN 'misc.py' END || ':function:only' || n, 'global' FROM c UNION ALL
  SELECT n, k, 'near' || s, 'lib/s' || s || '.py:function:near' || s, 'global' FROM c WHERE k % 4 = 0 UNION ALL
  SELECT n, k, 'nowhere' || k, NULL, NULL FROM c)
UNION ALL SELECT 'p' || n, path || ':function:' || f || s, 'near' || s, path || ':function:near' || s, 'same_file' FROM lib
UNION ALL SELECT 'p' || n, path || ':method:Kind' || s || '.act' || s, 'self.rest' || s, path || ':method:Kind' || s || '.rest' || s, 'same_file' FROM lib
"""
)
def index_refresh(spark, sf):
    """What a refreshed index of all nations' projects tells of their calls: only changed files are scanned, only touched buckets written."""
    root = f"{folder(spark)}/index-{uuid.uuid4().hex}"
    G.build(spark, root, project_files(spark, sf), buckets=16)
    G.refresh(spark, root, edited_files(spark, sf))
    return G.read(spark, root, "resolved").where("type = 'calls'").select("project", "source", "target", "found", "stage")


def _asked(spark, sf):
    """(query_id, term, q): every passage of ``benchmark`` a query of its tokens."""
    b = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(tokens(F.col("text"))).alias("term"))
    return b.groupBy("query_id", "term").agg(F.count("*").cast("double").alias("q"))


def _place(spark):
    return f"{folder(spark)}/blocks-{uuid.uuid4().hex}"


ASKED = (
    TOK
    + r""", bq AS (
  SELECT item_id, lower(t) AS term, count(*) AS q FROM (
    SELECT item_id, unnest(string_split_regex(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[ _]+')) AS t
    FROM (SELECT item_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM benchmark)) WHERE length(t) >= 2 GROUP BY 1, 2)
"""
)


@query(
    f"""WITH {ASKED}, s AS (
      SELECT item_id, doc_id, round(sum(q * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM bq JOIN post USING (term) JOIN stat USING (term) JOIN len USING (doc_id), corpus GROUP BY 1, 2)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""
)
def stored_topk(spark, sf):
    """The ten best documents for every benchmark passage from stored BM25 blocks, all passages at once."""
    at = _place(spark)
    B.save_bm25(load(spark, sf, "documents"), "doc_id", "text", at, "lang")
    return B.search_saved(spark, at, _asked(spark, sf), k=10)[0].select(F.col("query_id").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


@query(
    f"""WITH {ASKED}, w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM post JOIN stat USING (term), corpus),
    v AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
    s AS (SELECT item_id, doc_id, round(sum(w), 6) AS score FROM v JOIN bq USING (term) GROUP BY 1, 2)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 5"""
)
def stored_vectors(spark, sf):
    """The five nearest TF-IDF vectors for every benchmark passage from stored vectors; each of its terms counts once."""
    at = _place(spark)
    B.save_tfidf(load(spark, sf, "documents"), "doc_id", "text", at)
    return B.search_saved(spark, at, _asked(spark, sf).withColumn("q", F.lit(1.0)), k=5)[0].select(F.col("query_id").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


@query(f"WITH {PMI} SELECT y AS term, round(sum(pmi), 6) AS score FROM top WHERE x IN ('steel', 'brand', 'small') AND y NOT IN ('steel', 'brand', 'small') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def stored_concepts(spark, sf):
    """The concept graph of parts, stored, and a query widened by what is read of it."""
    at, asked = _place(spark), ["steel", "brand", "small"]
    B.save_related(_related(spark, sf), at)
    return S.expand(B.load_related(spark, at, asked), asked)
