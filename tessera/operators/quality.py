"""Line-level quality: complexity, duplicates, markers, rules, secrets; health scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.shared import spread
from tessera.functions.text import lines


def complexity(n_lines: Column, depth: Column, params: Column, branches: Column, limit: int = 80) -> Column:
    """Lines over ``limit`` by tens, 5 a level over 3, 2 a parameter over 5, 1 a branch over 10."""
    over = F.when(n_lines > limit, F.floor((n_lines - limit) / 10)).otherwise(0)
    return over + 5 * F.greatest(depth - 3, F.lit(0)) + 2 * F.greatest(params - 5, F.lit(0)) + F.greatest(branches - 10, F.lit(0))


def numbered_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, content) with lines from 1."""
    return spread(files.select(key, text)).select(key, F.posexplode(lines(F.col(text))).alias("line", "content")).withColumn("line", F.col("line") + 1)


def chunks(files: DataFrame, key: str, text: str, size: int = 6) -> DataFrame:
    """(key, start, end, hash): MD5 of every run of ``size`` trimmed non-blank lines, and the lines of the first and last.

    Cut inside each row's line array, so no text is shuffled.
    """
    real = F.filter(F.transform(lines(F.col(text)), lambda x, i: F.struct((i + 1).alias("line"), F.trim(F.regexp_replace(x, r"\s+", " ")).alias("s"))), lambda x: x["s"] != "")
    f = files.select(key, real.alias("l")).where(F.size("l") >= size)
    starts = f.select(key, "l", F.explode(F.sequence(F.lit(1), F.size("l") - size + 1)).alias("i"))
    run = F.array_join(F.transform(F.slice("l", F.col("i"), size), lambda x: x["s"]), "\n")
    return starts.select(key, F.element_at("l", F.col("i")).getField("line").alias("start"), F.element_at("l", F.col("i") + size - 1).getField("line").alias("end"), F.md5(run.cast("binary")).alias("hash"))


def duplicate_blocks(chunk: DataFrame, key: str) -> DataFrame:
    """(hash, copies, files, first file and line): every run found more than once, as a class, not as pairs."""
    g = chunk.groupBy("hash").agg(F.count("*").alias("copies"), F.countDistinct(key).alias("files"), F.min(F.struct(key, "start")).alias("f"))
    return g.where("copies > 1").select("hash", "copies", "files", F.col(f"f.{key}").alias("first_file"), F.col("f.start").alias("first_line"))


def duplicated_regions(chunk: DataFrame, key: str, slack: int = 2) -> DataFrame:
    """(key, start, end): maximal stretches of a file made of runs found more than once, joined where at most ``slack`` lines part them.

    Only repeated hashes are joined back, and a window holds one file's rows.
    """
    repeated = chunk.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    order = W.partitionBy(key).orderBy("start", "end")
    d = chunk.join(repeated, "hash", "left_semi").select(key, "start", "end").distinct()
    d = d.withColumn("reach", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    d = d.withColumn("region", F.sum(F.when(F.col("start") - F.col("reach") <= slack, 0).otherwise(1)).over(order))
    return d.groupBy(key, "region").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("region")


def duplicate_rate(chunk: DataFrame, size: int = 6) -> DataFrame:
    g = chunk.groupBy("hash").agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("chunks"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicated")).withColumn("rate", F.round(F.col("duplicated") / F.col("chunks"), 6))


def scan(files: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, line, rule, content): lines that a rule's pattern is found in. Rules are few, so a line is tested in place and only hits are emitted."""
    l = numbered_lines(files, key, text)  # noqa: E741
    hit = F.filter(F.array(*[F.when(F.col("content").rlike(p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())
    return l.select(key, "line", "content", F.explode(hit).alias("rule"))


def masked(content: Column) -> Column:
    """Quoted values: their first four characters, then stars."""
    return F.regexp_replace(content, r'"([^"]{4})[^"]*"', '"$1****"')


def health(complex_pct: Column, dead_pct: Column, documented_pct: Column, referenced_pct: Column) -> Column:
    """Four dimensions of 25 points."""
    part = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(25.0), c))
    return part(25 - 100 * complex_pct) + part(25 - 100 * dead_pct) + part(25 * documented_pct / 0.7) + part(25 * referenced_pct)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def ranked(df: DataFrame, by: str, *order: Column | str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)))
