"""Versions of a table: change detection, incremental postings, schema contracts, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detect_changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, deleted or modified by comparing digests; unchanged keys are left out."""
    o, n = old.select(key, F.col(digest).alias("o")), new.select(key, F.col(digest).alias("n"))
    j = o.join(n, key, "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified")
    return j.select(key, change.alias("change")).where("change is not null")


def update_postings(posts: DataFrame, changes: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Postings after a change: those of untouched documents, and ``fresh`` ones of added and modified documents."""
    return posts.join(changes.select(key), key, "left_anti").unionByName(fresh)


def compare_schemas(producer: DataFrame, consumer: DataFrame) -> DataFrame:
    """(model, field, issue, severity) of schema rows (model, field, type, optional)."""
    p = producer.select("model", "field", F.col("type").alias("p_type"), F.col("optional").alias("p_optional"))
    c = consumer.select("model", "field", F.col("type").alias("c_type"), F.col("optional").alias("c_optional"))
    issue = (
        F.when(F.col("c_type").isNull(), "missing_in_consumer").when(F.col("p_type").isNull(), "missing_in_producer")
        .when(F.col("p_type") != F.col("c_type"), "type_mismatch").when(F.col("p_optional") & ~F.col("c_optional"), "optionality_mismatch")
    )
    severity = F.when(F.col("issue") == "missing_in_consumer", "info").when(F.col("issue") == "optionality_mismatch", "warning").otherwise("error")
    return p.join(c, ["model", "field"], "full_outer").withColumn("issue", issue).where("issue is not null").select("model", "field", "issue", severity.alias("severity"))


def layer_violations(edges: DataFrame, layers: DataFrame, allowed: DataFrame) -> DataFrame:
    """(from_layer, to_layer, n): edges (source, target) between layers (id, layer) with no row in ``allowed``."""
    e = edges.join(layers.select(F.col("id").alias("source"), F.col("layer").alias("from_layer")), "source")
    e = e.join(layers.select(F.col("id").alias("target"), F.col("layer").alias("to_layer")), "target")
    e = e.where("from_layer <> to_layer").groupBy("from_layer", "to_layer").agg(F.count("*").alias("n"))
    return e.join(allowed, ["from_layer", "to_layer"], "left_anti")
