"""Search: postings, BM25, TF-IDF cosine, co-occurrence (PMI) concepts, keyword scores, rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.shared import spread, written
from tessera.functions.text import tokens

#: Fixed values of the scoring formulas.
K1, B, MIN_SIMILARITY, RRF_K, RRF_ALPHA = 1.5, 0.75, 0.01, 60, 0.7


#: Terms whose weights are sent to all tasks, the commonest; the others meet theirs in a join.
COMMON = 50_000


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf). Terms are counted inside each row; only where rows share a key, which keys alone tell, are they added up."""
    p = counted(docs, text, key).select(key, F.explode("posts").alias("p")).select(key, "p.term", "p.tf")
    again = docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return p if again.isEmpty() else p.groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def counted(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, dl, posts: array of term and tf): terms are counted inside each row, by runs of its sorted tokens, so nothing is shuffled."""
    # generators keep the optimizer from copying what they give into every use of it
    t = spread(docs.select(*keep, text)).select(*keep, F.explode(F.array(F.sort_array(tokens(F.col(text))))).alias("_t"))
    runs = F.when(F.size("_t") > 0, F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1)))).otherwise(F.array().cast("array<int>"))
    t = t.select(*keep, "_t", F.explode(F.array(runs)).alias("_at"))
    posts = F.transform("_at", lambda b, i: F.struct(F.get("_t", b).alias("term"), (F.coalesce(F.get("_at", i + 1), F.size("_t")) - b).cast("long").alias("tf")))
    return t.select(*keep, F.size("_t").alias("dl"), posts.alias("posts"))


def term_stats(posts: DataFrame, n: int) -> DataFrame:
    """(term, df, idf) with the BM25 idf over ``n`` documents."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k: int = 20) -> DataFrame:
    """The ``k`` best (key, score); a query term counts as often as it is given.

    No shuffle of documents: frequencies of the query's terms are counted
    inside each row and written, the corpus statistics are one row. For many
    queries of one corpus see ``keyword.save_postings``.
    """
    terms = sorted(set(query))
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    # a generator keeps the optimizer from copying the tokenizer into every count
    t = spread(docs.select(key, text)).select(key, F.explode(F.array(tokens(F.col(text)))).alias("_t"))
    times = lambda q: F.size(F.filter("_t", lambda x: x == q))
    t = written(t.select(key, F.size("_t").alias("dl"), *[times(q).alias(f"tf{i}") for i, q in enumerate(terms)]), "frequencies")
    s = t.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i, q in enumerate(terms):
        df, tf = s[f"df{i}"], F.col(f"tf{i}")
        idf = F.log(F.lit((s["n"] - df + 0.5) / (df + 0.5) + 1))
        score = score + query.count(q) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(s["avgdl"] or 1.0)))
    return t.select(key, F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def tfidf(posts: DataFrame, key: str, n: int) -> DataFrame:
    """(key, term, w): (1 + ln tf) * idf, each document's vector of length one.

    Postings and weights are written first. The weights of the ``COMMON``
    commonest terms, which most postings hold, go to all tasks; only postings
    of the other terms are shuffled. Lengths are sums that map tasks begin, so
    a filter on terms reaches the postings and leaves the rest out of the join.
    """
    posts = written(posts, "postings")
    idf = written(posts.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf")), "terms")
    top = written(idf.orderBy(F.desc("df"), "term").limit(COMMON).select("term", "idf"), "common")
    w = ((1 + F.log("tf")) * F.col("idf")).alias("w")
    raw = posts.join(F.broadcast(top), "term").select(key, "term", w)
    if top.count() == COMMON:
        rest = posts.join(F.broadcast(top.select("term")), "term", "left_anti")
        raw = raw.union(rest.join(idf.join(F.broadcast(top.select("term")), "term", "left_anti"), "term").select(key, "term", w))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def cosine_topk(vectors: DataFrame, query: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The ``k`` best (key, score) of sparse ``vectors`` against ``query`` (term, q), a few rows."""
    words = [r["term"] for r in query.select("term").distinct().collect()]
    s = vectors.where(F.col("term").isin(words)).join(F.broadcast(query), "term").groupBy(key).agg(F.round(F.sum(F.col("w") * F.col("q")), 6).alias("score"))
    return s.where(F.col("score") > MIN_SIMILARITY).orderBy(F.desc("score"), key).limit(k)


def cooccurrence(groups: DataFrame, group: str, weight: float = 1.0) -> DataFrame:
    """(x, y, c): weights of ordered pairs of different terms that share a group. ``groups`` has distinct (group, term)."""
    sets = groups.groupBy(group).agg(F.array_sort(F.collect_set("term")).alias("t"))
    x = sets.select("t", F.explode("t").alias("x"))
    return x.select("x", F.explode("t").alias("y")).where("x <> y").groupBy("x", "y").agg((F.count("*") * weight).alias("c"))


def pmi(pairs: DataFrame, k: int = 15) -> DataFrame:
    """(x, y, pmi): the ``k`` terms of largest positive smoothed PMI for each term seen at least twice."""
    z = pairs.agg(F.sum("c").alias("z")).first()["z"] or 0.0
    f = pairs.groupBy("x").agg(F.sum("c").alias("f"))
    j = pairs.join(f.withColumnRenamed("f", "fx"), "x").join(f.select(F.col("x").alias("y"), F.col("f").alias("fy")), "y")
    v = F.log(((F.col("c") + 0.1) / F.lit(float(z))) / ((F.col("fx") / F.lit(float(z))) * (F.col("fy") / F.lit(float(z))) + 1e-10))
    j = j.where("fx >= 2 and fy >= 2").select("x", "y", F.round(v, 6).alias("pmi")).where("pmi > 0")
    return j.withColumn("r", F.row_number().over(W.partitionBy("x").orderBy(F.desc("pmi"), "y"))).where(F.col("r") <= k).select("x", "y", "pmi")


def expand(related: DataFrame, query: list[str], k: int = 20) -> DataFrame:
    """(term, score): the ``k`` terms of largest summed PMI to the query's, themselves left out."""
    s = related.where(F.col("x").isin(query) & ~F.col("y").isin(query)).groupBy(F.col("y").alias("term")).agg(F.round(F.sum("pmi"), 6).alias("score"))
    return s.orderBy(F.desc("score"), "term").limit(k)


def vector_topk(vectors: DataFrame, key: str, vector: str, probe: list[float], k: int = 20) -> DataFrame:
    """The ``k`` nearest by cosine; dot products stay in the JVM."""
    q = F.array(*[F.lit(float(x)) for x in probe])
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    add = lambda a, x: a + x
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), add)
    norm = F.sqrt(F.aggregate(F.transform(v, lambda a: a * a), F.lit(0.0), add))
    length = sum(x * x for x in probe) ** 0.5
    s = vectors.select(key, F.round(dot / (norm * F.lit(length)), 6).alias("score"))
    return s.orderBy(F.desc("score"), key).limit(k)


def fuse(first: DataFrame, second: DataFrame, key: str, k: int = 20) -> DataFrame:
    """Reciprocal rank fusion of two short ranked lists (key, score)."""
    by = W.orderBy(F.desc("score"), key)
    a = first.select(key, (RRF_ALPHA / (RRF_K + F.row_number().over(by))).alias("a"))
    b = second.select(key, ((1 - RRF_ALPHA) / (RRF_K + F.row_number().over(by))).alias("b"))
    s = a.join(b, key, "full_outer").select(key, F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 8).alias("score"))
    return s.orderBy(F.desc("score"), key).limit(k)


def fuzzy(items: DataFrame, key: str, name: str, query: str, least: float = 0.6) -> DataFrame:
    """(key, name, score) of names whose edit similarity to ``query`` is at least ``least``: 30 if equal, 10 more if contained, 15 times the similarity."""
    low, q = F.lower(name), query.lower()
    near = 1 - F.levenshtein(low, F.lit(q)) / F.greatest(F.length(low), F.lit(len(q)))
    score = F.when(low == q, 30.0).otherwise(0.0) + F.when(low.contains(q), 10.0).otherwise(0.0) + near * 15
    return items.where((near >= least) | low.contains(q)).select(key, name, F.round(score, 6).alias("score"))
