"""The driver's tables, and the relations of the engine's model as they are bound to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shared import SHARE, dealt_by, shares


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, type): the dependency edges of the star schema, ids as ``table:key``."""
    t = lambda n: load(spark, sf_dir, n)
    sid = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    li = t("lineitem")
    parts = [
        (t("nation"), sid("nation:", "n_nationkey"), sid("region:", "n_regionkey"), "extends"),
        (t("customer"), sid("customer:", "c_custkey"), sid("nation:", "c_nationkey"), "uses"),
        (t("supplier"), sid("supplier:", "s_suppkey"), sid("nation:", "s_nationkey"), "uses"),
        (t("orders"), sid("order:", "o_orderkey"), sid("customer:", "o_custkey"), "calls"),
        (li, sid("order:", "l_orderkey"), sid("part:", "l_partkey"), "calls"),
        (li, sid("order:", "l_orderkey"), sid("supplier:", "l_suppkey"), "calls"),
    ]
    out = None
    for df, a, b, kind in parts:
        e = df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"))
        out = e if out is None else out.union(e)
    return out


def changes(spark: SparkSession, sf_dir: str, share: int = SHARE) -> DataFrame:
    """(commit, ts, author, path, insertions, deletions, complexity): an order is a commit, a brand and size class of parts a file.

    Large inputs come dealt by commit, to as many partitions as their rows ask for.
    """
    li, o, p = (load(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    p = p.select("p_partkey", F.concat_ws("/", "p_brand", F.concat(F.lit("s"), F.expr("p_size div 10").cast("string"))).alias("path"), F.expr("p_size / 5.0").alias("complexity"))
    o = o.select("o_orderkey", F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("author"), "o_orderpriority")
    n = shares(li, share)  # of footers alone
    li = dealt_by(li.join(p, li["l_partkey"] == p["p_partkey"]), n, "l_orderkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("commit"), "ts", "author", "path", F.col("l_quantity").cast("long").alias("insertions"),
        F.floor(F.col("l_discount") * 100).alias("deletions"), "complexity", F.col("o_orderpriority").alias("priority"),
    )
