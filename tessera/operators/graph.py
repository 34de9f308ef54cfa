"""Typed edges: reverse index, bounded impact, simple paths, orphans, two-cycles, components, reference resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.shared import held, written


def reverse_index(edges: DataFrame) -> DataFrame:
    """(symbol_id, caller_id) of edges (source, target), each once."""
    return edges.select(F.col("target").alias("symbol_id"), F.col("source").alias("caller_id")).where("symbol_id is not null").distinct()


def reference_counts(edges: DataFrame) -> DataFrame:
    """(symbol_id, refs): distinct callers; partial sums by (symbol, caller) first, so a hot symbol is spread."""
    return reverse_index(edges).groupBy("symbol_id").agg(F.count("*").alias("refs"))


def impact(edges: DataFrame, root: Column | str, depth: int = 3) -> DataFrame:
    """(id, level): what depends on ``root`` through at most ``depth`` edges, with the least level.

    While a level's frontier is small, it is rows of the plan that are sent to
    where the edges are read, and no edge is shuffled. Beyond that the edges
    are written once, dealt and sorted by what they lead to, and so is every
    frontier. A level costs one join whatever came before it; the walk ends
    with the first empty frontier.
    """
    spark = edges.sparkSession
    frontier, few = held(spark.range(1).select((F.lit(root) if isinstance(root, str) else root).alias("id"), F.lit(0).alias("level")), "frontier")
    step = edges.select(F.col("target").alias("id"), F.col("source").alias("next")).where("id is not null")
    dealt = None
    levels = [frontier]
    for level in range(1, depth + 1):
        if few:
            new = step.join(F.broadcast(frontier.select("id")), "id")
        else:
            dealt = dealt or written(step.distinct().repartition("id").sortWithinPartitions("id"), "edges")
            new = frontier.join(dealt, "id")
        new = new.select(F.col("next").alias("id")).distinct()
        for seen in levels:
            new = new.join(seen.select("id"), "id", "left_anti")
        new = new.withColumn("level", F.lit(level))
        if level == depth:  # nothing follows: it need not be kept
            levels.append(new)
            break
        frontier, few = held(new, "frontier")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out


def simple_paths(edges: DataFrame, starts: DataFrame, depth: int = 8, branch: int | None = 10) -> DataFrame:
    """(start, path, ended) along edges (source, target) from ``starts`` (id), no node twice.

    At most ``branch`` next nodes each are followed, by id; a path whose last
    node had more is marked once more, as "branch". None follows all. Every
    level is written, so that the plan grows by one join a level.
    """
    e = written(edges.select("source", "target").distinct(), "edges")
    fan = e.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("target")))
    fan = fan.select(F.col("source").alias("at"), "target", "r")
    live = starts.select(F.col("id").alias("start"), F.array("id").alias("path"))
    done = []
    for _ in range(depth):
        j = live.withColumn("at", F.element_at("path", -1)).join(fan, "at", "left")
        j = written(j.withColumn("ok", F.col("target").isNotNull() & ~F.array_contains("path", F.coalesce("target", F.lit("")))), "paths")
        within = F.lit(True) if branch is None else F.coalesce(F.col("r") <= branch, F.lit(True))
        ends = j.groupBy("start", "path").agg(F.max((F.col("ok") & within).cast("int")).alias("any"), F.max((~within).cast("int")).alias("more"))
        done.append(ends.where("any = 0 and more = 0").select("start", "path", F.lit("leaf").alias("ended")))
        done.append(ends.where("more = 1").select("start", "path", F.lit("branch").alias("ended")))
        live = j.where(F.col("ok") & within).select("start", F.concat("path", F.array("target")).alias("path"))
        if live.isEmpty():
            break
    out = live.select("start", "path", F.lit("depth").alias("ended"))
    for rows in done:
        out = out.union(rows)
    return out


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id, ...) that no edge targets."""
    return nodes.join(edges.select(F.col("target").alias("id")), "id", "left_anti")


def two_cycles(edges: DataFrame) -> DataFrame:
    """(a, b), a < b, with edges both ways."""
    e = edges.select("source", "target").distinct()
    fwd = e.where("source < target").select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = e.where("source > target").select(F.col("target").alias("a"), F.col("source").alias("b"))
    return fwd.join(back, ["a", "b"], "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of edges (a, b) by least label with pointer jumping, until nothing changes; every round is written to the shared folder."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = both.select(F.col("a").alias("id")).distinct().withColumn("root", F.col("id"))
    changed = True
    while changed:
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("root").alias("m"))
        low = label.join(near, label["id"] == near["a"]).select("id", F.least("root", "m").alias("low"), F.col("root").alias("old"))
        up = label.select(F.col("id").alias("low"), F.col("root").alias("above"))
        nxt = written(low.join(up, "low").select("id", F.least("low", "above").alias("root"), "old"), "labels")
        changed = not nxt.where("root <> old").isEmpty()
        label = nxt.select("id", "root")
    return label


def first_resolved(edges: DataFrame, key: str, stages: list[DataFrame]) -> DataFrame:
    """(key, target, stage): per edge the target of the first stage that knows one, the least id within it.

    Each stage is (key, target). The cascade is one union and a grouped
    minimum, not a chain of joins.
    """
    all_ = None
    for i, s in enumerate(stages):
        s = s.select(key, F.struct(F.lit(i).alias("stage"), F.col("target").alias("target")).alias("c"))
        all_ = s if all_ is None else all_.union(s)
    best = all_.groupBy(key).agg(F.min("c").alias("c"))
    return edges.select(key).distinct().join(best.hint("merge"), key, "left").select(key, "c.target", "c.stage")


def implements(members: DataFrame, required: DataFrame) -> DataFrame:
    """(owner, interface) for owners whose methods include all of an interface's: relational division of (owner, method) by (interface, method)."""
    need = required.distinct().groupBy("interface").agg(F.count("*").alias("n"))
    has = members.distinct().join(required.distinct(), "method").groupBy("owner", "interface").agg(F.count("*").alias("k"))
    return has.join(need, "interface").where("k = n").select("owner", "interface")
