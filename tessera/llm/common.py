"""Reading tables, shared scratch space and text helpers used by all operators of this folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What contracts call white space between words (ASCII only), for Java and RE2 patterns.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table under ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a session with a local master gets a temporary one;
    on a cluster it is an error, as its machines don't share their disks.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(known)
    return known


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a small table, as loops need between rounds."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def row_key(df: DataFrame) -> Column:
    """A digest of a whole row, which ids that are null or repeated cannot tell apart; equal rows have equal keys.

    The hash passes over nulls, so flags tell which columns are null.
    """
    return F.xxhash64(*df.columns, *[F.col(c).isNull() for c in df.columns])


def small_or_joined(df: DataFrame, label: str, rows: int = 1_000_000) -> DataFrame:
    """``df``, narrow rows, written once and marked for broadcast if there are at most ``rows``; else left for an ordinary join."""
    kept = saved(df, label)
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


def unused(df: DataFrame, name: str) -> str:
    """A column name made of ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name
