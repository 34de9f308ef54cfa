"""Intervals: overlap joins, coverage, compact ranges of missing points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of closed intervals (start, end) of one ``key`` that overlap: ``a``'s columns and b_start, b_end.

    An interval's level is the power of two that its length comes up to; at
    that width it lies in two bins at most. The shorter of a pair looks for
    the longer at the longer one's level, of which there are some sixty at
    most, so that no length makes many rows. Both sides are dealt by (key,
    level, bin); a pair is kept in the bin of its larger start only. Intervals
    that end before they start overlap nothing.
    """
    level = lambda s, e: F.ceil(F.log2((F.col(e) - F.col(s) + 1).cast("double"))).cast("int")
    wide = lambda l: F.pow(F.lit(2.0), l).cast("long")
    at = lambda c, l: F.floor(F.col(c) / wide(l)).cast("long")
    left = a.where("start <= end").withColumn("_own", level("start", "end"))
    right = b.where(F.col("start") <= F.col("end")).select(key, F.col("start").alias("b_start"), F.col("end").alias("b_end")).withColumn("_own", level("b_start", "b_end"))
    there = {side: sorted(r[0] for r in df.select("_own").distinct().collect()) for side, df in (("a", left), ("b", right))}  # levels, sixty-four at most

    def dealt(df: DataFrame, s: str, e: str, levels: list[int] | None, strict: bool = False) -> DataFrame:
        """Rows in their bins at their own level, or at all of ``levels`` from there on."""
        if levels is not None:
            every = F.array(*map(F.lit, levels)).cast("array<int>")
            df = df.withColumn("level", F.explode(F.filter(every, lambda l: (l > F.col("_own")) if strict else (l >= F.col("_own")))))
        else:
            df = df.withColumn("level", F.col("_own"))
        return df.drop("_own").withColumn("bin", F.explode(F.sequence(at(s, F.col("level")), at(e, F.col("level")))))

    on = [key, "level", "bin"]
    one = dealt(left, "start", "end", there["b"]).join(dealt(right, "b_start", "b_end", None), on)
    two = dealt(left, "start", "end", None).join(dealt(right, "b_start", "b_end", there["a"], True), on)
    j = one.unionByName(two).where("start <= b_end and b_start <= end")
    return j.where(F.col("bin") == F.floor(F.greatest("start", "b_start") / wide(F.col("level")))).drop("level", "bin")


def ranges(points: DataFrame, key: str, point: str) -> DataFrame:
    """(key, start, end, n): runs of consecutive distinct points."""
    p = points.select(key, point).distinct()
    p = p.withColumn("g", F.col(point) - F.row_number().over(W.partitionBy(key).orderBy(point)))
    return p.groupBy(key, "g").agg(F.min(point).alias("start"), F.max(point).alias("end"), F.count("*").alias("n")).drop("g")


def _islands(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end): the spans of a key joined where they overlap or touch."""
    s = spans.where("start <= end").select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    order = W.partitionBy(key).orderBy("start", "end")
    s = s.withColumn("_reach", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    s = s.withColumn("_island", F.sum(F.when(F.col("start") <= F.col("_reach") + 1, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def _inside(islands: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """(key, start, end, point): the distinct points of ``covered`` in their islands, by one sorted pass of both."""
    none = F.lit(None).cast("long")
    p = covered.select(key, F.col("point").cast("long").alias("point")).where("point is not null").distinct()
    rows = islands.select(key, F.col("start").alias("_at"), F.lit(0).alias("_kind"), "start", "end").union(p.select(key, F.col("point"), F.lit(1), none, none))
    order = W.partitionBy(key).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.last("start", True).over(order)).withColumn("end", F.last("end", True).over(order))
    return rows.where("_kind = 1 and _at <= end").select(key, "start", "end", F.col("_at").alias("point"))


def uncovered(spans: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """(key, start, end, n): ranges of points in ``spans`` (key, start, end) that ``covered`` (key, point) lacks; no span is taken apart into points."""
    islands = _islands(spans, key)
    p = _inside(islands, covered, key)
    before = F.lag("point").over(W.partitionBy(key, "start").orderBy("point"))
    gaps = p.select(key, (F.coalesce(before, F.col("start") - 1) + 1).alias("a"), (F.col("point") - 1).alias("b"))
    last = p.groupBy(key, "start").agg(F.max("point").alias("_last"))
    tails = islands.join(last, [key, "start"], "left").select(key, F.coalesce(F.col("_last") + 1, F.col("start")).alias("a"), F.col("end").alias("b"))
    return gaps.union(tails).where("a <= b").select(key, F.col("a").alias("start"), F.col("b").alias("end"), (F.col("b") - F.col("a") + 1).alias("n"))


def coverage(spans: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """(key, total, covered, pct) of the points in ``spans``, each counted once."""
    islands = _islands(spans, key)
    c = _inside(islands, covered, key).groupBy(key).agg(F.count("*").alias("covered"))
    g = islands.groupBy(key).agg(F.sum(F.col("end") - F.col("start") + 1).alias("total")).join(c, key, "left").fillna(0, ["covered"])
    return g.select(key, "total", "covered", F.round(100 * F.col("covered") / F.col("total"), 6).alias("pct"))
