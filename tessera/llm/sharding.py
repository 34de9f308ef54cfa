"""Sharding by extendible hashing.

Documents are addressed by the leading bits of a hash of their id. A bucket
that holds more bytes than the limit is split on one more bit, others are left
as they are, until all fit. Only the directory's counts are worked on: bytes
are summed per prefix once, at a depth a few bits beyond what even sizes need;
what is still too large there is summed again deeper.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, table, text_or_empty

#: Bits of a key; bytes of a shard at most; bits summed beyond the even depth.
BITS, LIMIT, SPARE = 60, 256 << 10, 6


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, key: the first 60 bits of the id's MD5."""
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), key.alias("key"))


def prefix(depth: int):
    return F.shiftrightunsigned("key", BITS - depth) if depth else F.lit(0).cast("long")


def split(rows: DataFrame, limit: int, top: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Directory between two depths: (leaf at ``depth``, its bucket's depth, prefix, bytes, rows), and the leaves that are still too large."""
    leaf = cut(rows.groupBy(prefix(depth).alias("leaf")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")))
    each = leaf.withColumn("depth", F.explode(F.sequence(F.lit(top), F.lit(depth))))
    at = F.expr(f"shiftright(leaf, cast({depth} - depth as int))")
    sums = each.groupBy("depth", at.alias("prefix")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    large = sums.where(F.col("shard_bytes") > limit)
    # children of split buckets, and the top ones, that are not split themselves
    kids = large.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")).where(F.col("depth") <= depth)
    roots = sums.where(F.col("depth") == top).select("depth", "prefix")
    final = kids.union(roots).join(large.select("depth", "prefix"), ["depth", "prefix"], "left_anti").join(sums, ["depth", "prefix"])
    # of the leaves that exist, each finds its bucket among the prefixes above it, at the depths that buckets have: one of the first depths would hold all leaves
    depths = [r["depth"] for r in final.select("depth").distinct().collect()]
    each = each.where(F.col("depth").isin(depths))
    return each.select("leaf", "depth", at.alias("prefix")).join(final, ["depth", "prefix"]), large.where(F.col("depth") == depth).select(F.col("prefix").alias("leaf"))


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, shard, depth, n_bytes, shard_bytes, shard_docs, oversized of every row.

    A shard's name is its prefix in bits ("" if all rows fit one). Null ids
    hash as empty text, null texts have no bytes. Rows of one id stay together:
    a shard is over the limit, and marked, only if one id's rows alone are.
    """
    rows = keyed(docs)
    total = rows.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    top, depth = 0, min(BITS, SPARE + max(0, math.ceil(math.log2(max(1, total) / limit))))
    parts = []
    while True:
        found, large = split(rows, limit, top, depth)
        parts.append(_named(rows.withColumn("leaf", prefix(depth)).join(found, "leaf"), False))
        large = cut(large)
        if large.isEmpty():
            break
        rest = rows.withColumn("leaf", prefix(depth)).join(large, "leaf").drop("leaf")
        if depth == BITS:
            one = rest.groupBy("key").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
            parts.append(_named(rest.join(one, "key").withColumn("depth", F.lit(BITS)).withColumn("prefix", F.col("key")), True))
            break
        rows, top, depth = rest, depth + 1, min(BITS, depth + 8)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _named(rows: DataFrame, oversized: bool) -> DataFrame:
    bits = F.when(F.col("depth") > 0, F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))).otherwise("")
    return rows.select("doc_id", bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "n_bytes", "shard_bytes", "shard_docs", F.lit(oversized).alias("oversized"))


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """The documents themselves, one folder of Parquet for every shard; a column named shard is replaced."""
    names = assign(docs, limit).select(F.col("doc_id").alias("_id"), "shard").distinct()
    rows = docs.drop("shard")
    rows.join(names, rows["doc_id"].eqNullSafe(names["_id"])).drop("_id").repartition("shard").write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every row of ``documents``; see ``assign`` for nulls, repeated ids and rows over the limit. An empty table gives no rows."""
    return assign(table(spark, sf_dir, "documents"))
