"""Event streams: sessions, sliding rate limits, most recently used lists; each works on static and streaming frames where Spark allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str = "24 hours", watermark: str | None = None) -> DataFrame:
    """(key, start, end, n): runs of events no further apart than ``gap``; with a watermark it runs as a stream in append mode."""
    e = events.withWatermark(ts, watermark) if watermark else events
    g = e.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def over_limit(events: DataFrame, key: str, ts: str, limit: int = 30, seconds: int = 60) -> DataFrame:
    """Events with the number of their key's events in the trailing window, and whether it passes ``limit``."""
    w = W.partitionBy(key).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("recent", F.count("*").over(w)).withColumn("limited", F.col("recent") > limit)


def recently_used(events: DataFrame, key: str, item: str, ts: str, cap: int = 50) -> DataFrame:
    """(key, item, last_ts, rank): the ``cap`` items touched last, newest first. Touches are reduced per item before they are ranked."""
    last = events.groupBy(key, item).agg(F.max(ts).alias("last_ts"))
    return last.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("last_ts"), item))).where(F.col("rank") <= cap)


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, watermark: str | None = None) -> DataFrame:
    """(start, keys, n) per window of ``width``."""
    e = events.withWatermark(ts, watermark) if watermark else events
    return e.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
