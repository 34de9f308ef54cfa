"""Tables in the folder that all executors share, which loops and reused results need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder for a local master and an error on a cluster."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: computed once, with no lineage behind it."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scope(*frames: DataFrame) -> list[str]:
    """``project`` where all frames have it: ids are a project's own, so it is part of every key then."""
    return ["project"] if all("project" in f.columns for f in frames) else []


#: Rows up to which a table is sent to all tasks.
SMALL = 100_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df``, narrow rows, marked for broadcast if it has been counted to have at most ``rows``; else left for an ordinary join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows up to which a loop's table is held by the driver between rounds.
HELD = 10_000


def held(df: DataFrame, label: str, rows: int = HELD) -> tuple[DataFrame, bool]:
    """``df``, narrow rows, computed once, and whether it is small: then it is rows of the plan, of which there are at most ``rows``, else a table of the shared folder."""
    kept = written(df, label)
    some = kept.limit(rows + 1).collect()
    return (df.sparkSession.createDataFrame(some, df.schema), True) if len(some) <= rows else (kept, False)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all tasks if it is read by fewer than there are, as a small file of one row group is; large inputs stay where they are read."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def dealt(df: DataFrame) -> DataFrame:
    """``df``, narrow rows of which each costs much later, dealt to twice as many partitions as there are tasks: a table of some megabytes is one partition, however many rows it has."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


#: Rows that a task sorts and groups: beyond this many a task, they are dealt to more.
SHARE = 500_000


def shares(df: DataFrame, share: int = SHARE) -> int:
    """Partitions for all rows of ``df``, which are counted; 0 where there are no more than tasks anyhow.

    Narrow rows compress so well that partitions of the usual bytes hold
    millions of them, which grow in sorts and hash tables.
    """
    n = df.count() // share
    return n if n > df.sparkSession.sparkContext.defaultParallelism else 0


def dealt_by(df: DataFrame, n: int, *key: str) -> DataFrame:
    """``df`` dealt by ``key`` to ``n`` partitions; as it is for none."""
    return df.repartition(n, *key) if n else df
