"""Changes are dealt by commit in shares of bounded rows, and co-change groups only the commits that count."""

from pyspark.sql import functions as F

from tessera.operators import history as H
from tessera.sources.tables import changes
from tests.oracle import SF


def test_changes_are_dealt_in_bounded_shares(spark):
    dealt = changes(spark, SF, share=500)
    sizes = dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) > spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) < 1500
    assert dealt.select("commit", F.spark_partition_id().alias("p")).distinct().groupBy("commit").count().where("count > 1").isEmpty()
    assert sorted(map(str, dealt.collect())) == sorted(map(str, changes(spark, SF).collect()))


def test_cochange_makes_only_its_own_commits_distinct(spark, monkeypatch):
    rows = [(k, "a" if k < 3 else "c", "x") for k in range(300)] + [(k, "b", "x") for k in range(300)] + [(0, "b", "x")]
    c = spark.createDataFrame(rows, "commit long, path string, author string")
    grouped = []
    distinct = type(c).distinct
    monkeypatch.setattr(type(c), "distinct", lambda self: grouped.append(self.count()) or distinct(self))
    assert [tuple(r) for r in H.cochange(c, "a").collect()] == [("b", 3, 1.0)]
    assert [tuple(r) for r in H.suggest(c, ["a"]).collect()] == [("b", 1.0)]
    assert max(grouped) <= 4
