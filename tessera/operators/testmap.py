"""Which tests are of which source: evidence of names, imports and references, and an assignment that settles ties for all at once.

Every pair of a source and a test with some evidence has a weight. Pairs are
in one order, by weight, then nearness; in a round every test proposes to the
source of its best pair, and a source takes a proposal that is its best pair
too. Both are then settled, and the next round is among the rest. What comes
out is what taking the best pair of all, again and again, would give. Tests
that no source is left for belong to the source of their best pair besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import written
from tessera.operators.project import test_names
from tessera.operators.resolution import path_of

#: Folders of tests, and the names of their files.
FOLDERS = ["tests", "test", "__tests__", "__test__", "spec", "specs"]
TEST_FILE = r"^test_.*\.py$|_test\.py$|\.(?:test|spec)\.[jt]sx?$|_test\.go$"
#: Weights: a name that fits, an import, and a reference, of which up to 99 count.
NAME, IMPORT, REFERENCE = 1000, 100, 1


def is_test(path: Column) -> Column:
    return F.substring_index(path, "/", -1).rlike(TEST_FILE) | F.exists(F.split(F.lower(path), "/"), lambda x: x.isin(FOLDERS))


def evidence(files: DataFrame, imports: DataFrame, callers: DataFrame) -> DataFrame:
    """(project, source, test, weight) of files (project, path).

    ``imports`` are (project, source, found) of imported symbols, ``callers``
    (project, symbol_id, caller_id).
    """
    f = files.select("project", "path").distinct().withColumn("is_test", is_test(F.col("path")))
    tests, sources = f.where("is_test").select("project", F.col("path").alias("test")), f.where("not is_test").select("project", F.col("path").alias("source"))
    named = sources.withColumn("name", F.explode(test_names(F.col("source")))).join(tests.withColumn("name", F.substring_index("test", "/", -1)), ["project", "name"])
    linked = lambda rows, source, test: rows.select("project", path_of(F.col(source)).alias("source"), path_of(F.col(test)).alias("test"))
    imported = linked(imports.where("found is not null"), "found", "source").distinct().withColumn("w", F.lit(IMPORT).cast("long"))
    referred = linked(callers, "symbol_id", "caller_id").groupBy("project", "source", "test").agg(F.least(F.count("*") * REFERENCE, F.lit(99)).alias("w"))
    by_name = named.select("project", "source", "test").distinct().withColumn("w", F.lit(NAME).cast("long"))
    every = by_name.union(imported).union(referred.select(*by_name.columns)).groupBy("project", "source", "test").agg(F.sum("w").alias("weight"))
    return every.join(tests, ["project", "test"], "left_semi").join(sources, ["project", "source"], "left_semi").select("project", "source", "test", "weight")


def assigned(pairs: DataFrame) -> DataFrame:
    """(project, source, test, weight, first) of ``evidence``'s pairs: each test once; ``first`` is the source's own, of which it has one at most."""
    depth = lambda c: F.regexp_count(c, F.lit("/"))
    order = F.struct((-F.col("weight")).alias("w"), F.abs(depth(F.col("test")) - depth(F.col("source"))).alias("d"), F.length("test").alias("n"), "test", "source")
    pairs = written(pairs.withColumn("order", order), "pairs")
    live, done = pairs, None
    while True:
        best = lambda side: live.groupBy("project", side).agg(F.min("order").alias("order"))
        both = best("test").join(best("source").withColumnRenamed("source", "by"), ["project", "order"]).where("order.source = by")
        now = written(both.select("project", F.col("order.source").alias("source"), "test"), "settled")
        if now.isEmpty():
            break
        done = now if done is None else done.union(now)
        live = written(live.join(now.select("project", "test"), ["project", "test"], "left_anti").join(now.select("project", "source"), ["project", "source"], "left_anti"), "pairs")
    if done is None:
        return pairs.select("project", "source", "test", "weight", F.lit(True).alias("first"))
    first = pairs.join(done, ["project", "source", "test"], "left_semi").select("project", "source", "test", "weight", F.lit(True).alias("first"))
    rest = pairs.join(done.select("project", "test"), ["project", "test"], "left_anti").groupBy("project", "test").agg(F.min("order").alias("o"))
    return first.union(rest.select("project", F.col("o.source").alias("source"), "test", (-F.col("o.w")).alias("weight"), F.lit(False).alias("first")))


def tested(pairs: DataFrame) -> DataFrame:
    """(project, path) of sources that some test belongs to, as ``conventions.untested`` and ``coverage_rate`` take it."""
    return pairs.select("project", F.col("source").alias("path")).distinct()
