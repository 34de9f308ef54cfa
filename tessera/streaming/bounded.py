"""A bound over all sessions: the least recently active ones go, whatever their keys.

Over a table the bound is exact: the sessions that were active last, as many
as there is room for. Over a stream each batch's last activities are merged
into a table of live sessions, in shares by key; a share tells its recency by a
quantile sketch, merged to one cutoff, and every share drops what is older.
No key has a timer and no task sees all keys. The cutoff's rank errs by at most
one part in ``ACCURACY`` of the live sessions, always towards keeping them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shared import folder

#: Sessions that are kept, seconds after which one is over.
MOST, TTL = 100, 86_400
#: Of a sketch: its ranks are right to one part in so many.
ACCURACY = 10_000


def last_active(events: DataFrame, key: str = "session", ts: str = "ts") -> DataFrame:
    """(session, last, n): a row of every session; null keys and times are left out."""
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    return rows.groupBy(F.col(key).alias("session")).agg(F.max(ts).alias("last"), F.count("*").alias("n"))


def live_sessions(events: DataFrame, most: int = MOST, ttl: int = TTL, key: str = "session", ts: str = "ts") -> DataFrame:
    """(session, last, n) of the ``most`` sessions that were active last and within ``ttl`` seconds of the newest event; ties by key."""
    s = last_active(events, key, ts)
    newest = s.agg(F.max("last").alias("newest"))
    fresh = s.join(F.broadcast(newest), F.unix_micros("newest") - F.unix_micros("last") <= ttl * 1_000_000).drop("newest")
    return fresh.orderBy(F.desc("last"), "session").limit(most)


def evicted_sessions(events: DataFrame, most: int = MOST, ttl: int = TTL, key: str = "session", ts: str = "ts") -> DataFrame:
    """(session, last, n) of those that ``live_sessions`` leaves out."""
    return last_active(events, key, ts).join(live_sessions(events, most, ttl, key, ts).select("session"), "session", "left_anti")


class Sessions:
    """The live sessions of a stream as a table in generations; ``take`` is what ``foreachBatch`` calls.

    A batch that comes again after a restart makes the same generation again,
    since it starts from the one before: nothing is counted twice.
    """

    def __init__(self, path: str, most: int = MOST, ttl: int = TTL, shares: int = 8, key: str = "session", ts: str = "ts"):
        self.path, self.most, self.ttl, self.shares, self.key, self.ts = path.rstrip("/"), most, ttl, shares, key, ts

    def read(self, spark: SparkSession, batch: int) -> DataFrame | None:
        """The generation after ``batch``; None before the first."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{batch}/_SUCCESS")
        there = batch >= 0 and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return spark.read.parquet(f"{self.path}/{batch}") if there else None

    def take(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = last_active(batch, self.key, self.ts)
        old = self.read(spark, number - 1)
        both = new if old is None else old.select("session", "last", "n").unionByName(new)
        merged = both.groupBy("session").agg(F.max("last").alias("last"), F.sum("n").alias("n")).withColumn("share", F.pmod(F.xxhash64("session"), F.lit(self.shares)).cast("int"))
        aside = f"{folder(spark)}/sessions-{number}"
        merged.write.mode("overwrite").parquet(aside)  # counted, then cut: computed once
        merged = spark.read.parquet(aside)
        at = F.unix_micros("last")
        n, newest = merged.agg(F.count("*"), F.max(at)).first()
        if n:
            cut = newest - self.ttl * 1_000_000
            if n > self.most:
                rank = max(0.0, 1 - self.most / n - 1 / ACCURACY)  # lower by what the sketch may err
                cut = max(cut, merged.agg(F.percentile_approx(at, rank, ACCURACY)).first()[0])
            merged = merged.where(at >= cut)
        merged.repartition("share").write.mode("overwrite").parquet(f"{self.path}/{number}")
