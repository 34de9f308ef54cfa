"""Change history: commits and the files they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.shared import written


def hotspots(changes: DataFrame, complexity: DataFrame) -> DataFrame:
    """(path, commits, authors, primary_author, complexity, score): commits * (1 + complexity / 10) of changes (commit, author, path)."""
    per = changes.groupBy("path", "author").agg(F.count("*").alias("n"))
    who = per.groupBy("path").agg(F.sum("n").alias("commits"), F.count("*").alias("authors"), F.min(F.struct((-F.col("n")).alias("m"), "author")).alias("p"))
    out = who.join(complexity, "path", "left").withColumn("complexity", F.coalesce("complexity", F.lit(0.0)))
    return out.select("path", "commits", "authors", F.col("p.author").alias("primary_author"), "complexity", F.round(F.col("commits") * (1 + F.col("complexity") / 10), 6).alias("score"))


def baskets(changes: DataFrame, least: int = 2, most: int = 30) -> DataFrame:
    """(commit, paths): sorted distinct files of commits that touch between ``least`` and ``most`` -- the operator's own definition of a basket."""
    b = changes.groupBy("commit").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return b.where(F.size("paths").between(least, most))


def rules(changes: DataFrame, min_support: int = 3, min_confidence: float = 0.3) -> DataFrame:
    """Association rules (a < b): support, both confidences, their mean, lift = mean / p(b).

    Pairs come from inside each bounded basket, without a self-join on commits.
    """
    b = baskets(changes)
    total = b.count()
    single = b.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    left = b.select("paths", F.posexplode("paths").alias("i", "a"))
    pairs = left.select("a", F.explode(F.slice("paths", F.col("i") + 2, F.size("paths"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("support"))
    pairs = pairs.where(F.col("support") >= min_support)
    j = pairs.join(single.select(F.col("path").alias("a"), F.col("n").alias("na")), "a").join(single.select(F.col("path").alias("b"), F.col("n").alias("nb")), "b")
    ab, ba = F.col("support") / F.col("na"), F.col("support") / F.col("nb")
    avg = (ab + ba) / 2
    return j.where(avg >= min_confidence).select("a", "b", "support", F.round(ab, 6).alias("conf_ab"), F.round(ba, 6).alias("conf_ba"), F.round(avg, 6).alias("confidence"), F.round(avg / (F.col("nb") / F.lit(total)), 6).alias("lift"))


def cochange(changes: DataFrame, path: str, least: int = 2) -> DataFrame:
    """(path, together, ratio): files of the commits that touch ``path``, seen with it at least ``least`` times.

    Only these commits' changes are made distinct.
    """
    mine = written(changes.where(F.col("path") == path).select("commit").distinct(), "commits")
    n = mine.count()
    other = changes.where(F.col("path") != path).select("commit", "path").join(mine, "commit", "left_semi").distinct()
    return other.groupBy("path").agg(F.count("*").alias("together")).where(F.col("together") >= least).select("path", "together", F.round(F.col("together") / F.lit(n), 6).alias("ratio"))


def suggest(changes: DataFrame, targets: list[str], min_confidence: float = 0.3) -> DataFrame:
    """(path, confidence): the largest P(path | target) over the targets."""
    t = written(changes.where(F.col("path").isin(targets)).select("commit", F.col("path").alias("target")).distinct(), "commits")
    n = t.groupBy("target").agg(F.count("*").alias("n"))
    o = changes.where(~F.col("path").isin(targets)).select("commit", "path").join(t.select("commit"), "commit", "left_semi").distinct()
    c = o.join(t, "commit").groupBy("target", "path").agg(F.count("*").alias("k")).join(n, "target")
    return c.groupBy("path").agg(F.round(F.max(F.col("k") / F.col("n")), 6).alias("confidence")).where(F.col("confidence") >= min_confidence)


def churn(changes: DataFrame) -> DataFrame:
    """(path, commits, authors, inserted, deleted, total)."""
    return changes.groupBy("path").agg(
        F.countDistinct("commit").alias("commits"), F.countDistinct("author").alias("authors"), F.sum("insertions").alias("inserted"),
        F.sum("deletions").alias("deleted"), (F.sum("insertions") + F.sum("deletions")).alias("total"),
    )


def risk(changes: DataFrame, risky: Column) -> DataFrame:
    """(commit, risk): 2 for each file over 5, 3 if ``risky``, 1 for each 100 lines, 2 if a complex file is touched."""
    g = changes.groupBy("commit").agg(
        F.countDistinct("path").alias("files"), F.bool_or(risky).alias("risky"), F.sum(F.col("insertions") + F.col("deletions")).alias("lines"),
        F.bool_or(F.col("complexity") > 5).alias("complex"),
    )
    score = 2 * F.greatest(F.col("files") - 5, F.lit(0)) + F.when(F.col("risky"), 3).otherwise(0) + F.floor(F.col("lines") / 100) + F.when(F.col("complex"), 2).otherwise(0)
    return g.select("commit", "files", "lines", score.cast("long").alias("risk"))


def freshness(age_days: Column) -> Column:
    return F.when(age_days <= 30, "fresh").when(age_days <= 90, "recent").when(age_days <= 180, "aging").when(age_days > 180, "stale")


def stale(symbols: DataFrame, least_refs: int = 3, days: int = 180) -> DataFrame:
    """Symbols (id, refs, age) referenced often and not changed for long, with refs * age."""
    return symbols.where((F.col("refs") >= least_refs) & (F.col("age") >= days)).withColumn("rank_score", F.col("refs") * F.col("age"))


def last_touched(changes: DataFrame, key: str, ts: str) -> DataFrame:
    return changes.groupBy(key).agg(F.max(ts).alias("last_ts"))


def newest_first(key: str) -> W:
    return W.partitionBy(key).orderBy(F.desc("ts"))
