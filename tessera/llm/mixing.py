"""Mixing sources to target weights along a low-discrepancy schedule, with DataFrame functions only.

Slot i of the schedule maps the golden-ratio point frac(i * phi) through the
cumulative weights of the sources. Slots are ranked within their source; rank
r draws block r of the source's shuffled stream of words, which is cut into
blocks of equal tokens and starts anew after the last. Small sources have
smaller blocks, and every source gets its target in blocks to the nearest one:
ranks beyond are cut, ranks that the points leave out are added at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, row_key, saved, table, text_or_empty, unused

WEIGHTS, MOST = (5, 2, 1), 3
GOLDEN = (math.sqrt(5) - 1) / 2
#: Slots of a schedule at most, while a block has at most BLOCK[1] tokens; blocks have at least BLOCK[0].
SLOTS, BLOCK = 1 << 18, (16, 1 << 16)
#: Blocks that a source has at least, if it has as many words, however large its table is.
PIECES = 256
#: Shares that a source's shuffle and its ranks are counted in, so that a hot source is many tasks' work.
SHARES, RUN = 4096, 4096
_ALL = (W.unboundedPreceding, W.unboundedFollowing)
_BEFORE = (W.unboundedPreceding, -1)


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long"))


def sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_id, source_size, target) of sized rows: weights repeat over the sources by code point, null last.

    Targets share all words by weight; none is above ``most`` times its
    source. Sources that are full at the common level are the first in order
    of capacity per weight, so one running sum finds the level.
    """
    s = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_id", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight: Column = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_id") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    by = W.orderBy(F.col("cap") / F.col("weight"), "source_id")
    everything = W.orderBy(F.lit(0)).rowsBetween(*_ALL)
    full = F.coalesce(F.sum("cap").over(by.rowsBetween(*_BEFORE)), F.lit(0.0))
    used = F.coalesce(F.sum("weight").over(by.rowsBetween(*_BEFORE)), F.lit(0.0))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - full) / (F.sum("weight").over(everything) - used))
    holds = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    s = s.withColumn("level", F.first(holds, ignorenulls=True).over(by.rowsBetween(*_ALL)))
    return s.select("source", "source_id", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def block_tokens(total: int) -> int:
    return min(BLOCK[1], max(BLOCK[0], -(-total // SLOTS)))


def blocks_of(block: int) -> Column:
    """Blocks of a source: of ``block`` tokens, or of fewer where that makes less than PIECES of it."""
    return F.expr(f"ceil(source_size / greatest(1, least({block}, source_size div {PIECES})))")


def blocked(src: DataFrame, block: int) -> DataFrame:
    """Adds, for every source that has words, the number of its blocks, its slots wanted (target in blocks), and its quota.

    The quota is the number of draws whose tokens come nearest to the target.
    """
    s = src.where("source_size > 0").withColumn("blocks", blocks_of(block))
    s = s.withColumn("wanted", F.col("target") * F.col("blocks") / F.col("source_size"))
    s = s.withColumn("_rounds", F.floor(F.col("target") / F.col("source_size"))).withColumn("_rest", F.col("target") - F.col("_rounds") * F.col("source_size"))
    s = s.withColumn("_at", _block_at("bigint(_rest)"))
    nearer = (_first_of("(_at + 1)") - F.col("_rest") < F.col("_rest") - _first_of("_at")).cast("int")
    quota = F.least(F.col("_rounds") * F.col("blocks") + F.col("_at") + nearer, MOST * F.col("blocks"))  # the cap on repeats holds to the word
    return s.withColumn("quota", quota).drop("_rounds", "_rest", "_at")


def schedule(spark: SparkSession, src: DataFrame, slots: int, cells: int = 256) -> DataFrame:
    """(slot, source_id, rank, epoch, block): ``src`` has source_id, blocks, wanted and quota.

    A point finds its source by an equi-join on the cell of [0, 1) that it
    falls in; the intervals of the sources are cut at the cells. Every source
    has ``quota`` slots; how far the points alone are off it follows
    the logarithm of the slots, and so do the slots added.
    """
    whole = F.sum("wanted").over(W.orderBy(F.lit(0)).rowsBetween(*_ALL))
    low = F.coalesce(F.sum("wanted").over(W.orderBy("source_id").rowsBetween(*_BEFORE)), F.lit(0.0)) / whole
    s = src.withColumn("low", low).withColumn("high", F.coalesce(F.lead("low").over(W.orderBy("source_id")), F.lit(1.0)))
    cell = lambda c: F.least(F.floor(F.col(c) * cells), F.lit(cells - 1))
    quota = src.select("source_id", "blocks", "quota")
    s = s.select("source_id", "blocks", "low", "high", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    point = F.col("slot") * F.lit(GOLDEN) + 0.5
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("x", point - F.floor(point)).withColumn("cell", cell("x"))
    hit = points.join(s, "cell").where("x >= low and x < high").select("slot", "source_id", "blocks", F.floor(F.col("slot") / RUN).alias("run"))
    runs = hit.groupBy("source_id", "run").agg(F.count("*").alias("n"))
    runs = runs.select("source_id", "run", "n", F.coalesce(F.sum("n").over(W.partitionBy("source_id").orderBy("run").rowsBetween(*_BEFORE)), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("source_id", "run").orderBy("slot")) - 1
    ranked = hit.withColumn("in_run", rank).join(runs, ["source_id", "run"]).withColumn("rank", F.col("before") + F.col("in_run"))
    ranked = ranked.join(quota.select("source_id", "quota"), "source_id").where("rank < quota").select("slot", "source_id", "blocks", "rank")
    short = quota.join(runs.groupBy("source_id").agg(F.sum("n").alias("n")), "source_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < quota")
    short = short.select("source_id", "blocks", F.explode(F.sequence(F.col("n"), F.col("quota") - 1)).alias("rank"))
    added = short.select((F.row_number().over(W.orderBy("rank", "source_id")) - 1 + slots).cast("long").alias("slot"), "source_id", "blocks", "rank")
    ranked = ranked.unionByName(added)
    return ranked.select("slot", "source_id", "rank", F.expr("rank div blocks").alias("epoch"), F.expr("rank % blocks").alias("block"))


def positions(docs: DataFrame, seed: int = 8, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``start``: the words before the row in its source's shuffled stream, rows of one id by size and ``ties``. Needs source_id and size; keeps all columns."""
    d = docs.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_share", F.shiftrightunsigned("_h", 64 - int(math.log2(SHARES))))
    shares = d.groupBy("source_id", "_share").agg(F.sum("size").alias("_n"))
    shares = shares.select("source_id", "_share", F.coalesce(F.sum("_n").over(W.partitionBy("source_id").orderBy("_share").rowsBetween(*_BEFORE)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("size").over(W.partitionBy("source_id", "_share").orderBy("_h", "doc_id", "size", *ties).rowsBetween(*_BEFORE)), F.lit(0))
    out = d.withColumn("_in", inside).join(shares, ["source_id", "_share"])
    return out.withColumn("start", F.col("_before") + F.col("_in")).drop("_h", "_share", "_in", "_before")


def _block_at(p: str) -> Column:
    """The block of place ``p``: the first source_size % blocks blocks have one token more."""
    return F.expr(f"if({p} < (source_size % blocks) * (source_size div blocks + 1), {p} div (source_size div blocks + 1), source_size % blocks + ({p} - (source_size % blocks) * (source_size div blocks + 1)) div (source_size div blocks))")


def _first_of(b: str) -> Column:
    return F.expr(f"{b} * (source_size div blocks) + least({b}, source_size % blocks)")


def _prepared(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Sized rows with their source's numbers, the sources, and all words."""
    src = sources(rows.select("source", "size"))
    total = src.agg(F.sum("source_size").alias("t")).first()["t"]
    src = src.withColumn("_key", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull())
    rows = rows.withColumn("_key", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull())
    rows = rows.join(src.drop("source"), ["_key", "_null"]).drop("_key", "_null")
    return rows, src.drop("_key", "_null"), int(total or 0)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of every row the mix takes, repeats counted.

    Texts are read once, for their sizes; the rest works on a narrow table.

    Null texts and texts without words have size 0 and are never taken; a null
    source is a source. Repeated rows are streamed each on its own. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    rows, src, total = _prepared(saved(sized(docs.select("doc_id", "source", "text")).drop("text"), "sizes"))
    rows = rows.select("doc_id", "size", "source_id", "source_size", "target")
    if not total:
        return rows.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    block = block_tokens(total)
    cut = blocked(src, block).select("source_id", "source_size", "blocks", "wanted", "quota")
    sums = cut.agg(F.sum("wanted").alias("n"), F.count("*").alias("c")).first()
    slots, cells = int(math.ceil(sums["n"])), max(256, sums["c"])
    drawn = schedule(spark, cut, slots, cells).groupBy("source_id", "block").agg(F.count("*").alias("times"))
    placed = positions(rows).withColumn("blocks", F.greatest(blocks_of(block), F.lit(1)))
    some, none = placed.where("size > 0"), rows.where("size = 0")
    each = some.withColumn("block", F.explode(F.sequence(_block_at("start"), _block_at("(start + size - 1)"))))
    over = F.least(F.col("start") + F.col("size"), _first_of("(block + 1)")) - F.greatest(F.col("start"), _first_of("block"))
    each = each.withColumn("over", over).join(drawn, ["source_id", "block"], "left")
    keys = ["doc_id", "size", "source_id", "source_size", "target", "start"]
    got = each.groupBy(*keys).agg(F.sum(F.col("over") * F.coalesce("times", F.lit(0))).alias("taken"))
    out = ["doc_id", "size", "source_size", "target", "taken"]
    return got.select(*out).union(none.withColumn("taken", F.lit(0).cast("long")).select(*out))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is drawn whole, and one for a last, partial draw.

    Blocks are drawn in order, so what a source gives is whole rounds of its
    stream and the first words of one more; a document at that edge is cut
    after its last word drawn. ``n_chars`` follows the text where there is one.
    Rows without words, null texts among them, are never drawn; a null source
    is a source. Sizes are counted once, and texts meet their draws in one
    join. All other columns are kept; an empty table stays empty.
    """
    spark, cols = docs.sparkSession, docs.columns
    # two digests of a whole row tell rows apart; rows alike in all columns share one text
    keys = [unused(docs, "row"), unused(docs, "again")]
    keyed = docs.withColumn(keys[0], row_key(docs)).withColumn(keys[1], F.xxhash64(F.lit(1), *docs.columns))
    narrow = keyed.select("doc_id", "source", *keys, "text").transform(sized).drop("text").withColumnsRenamed({keys[0]: "_row1", keys[1]: "_row2"})
    rows, src, total = _prepared(saved(narrow, "sizes"))
    if not total:
        return docs.limit(0)
    block = block_tokens(total)
    cut = blocked(src, block).select("source_id", "source_size", "blocks", "wanted", "quota")
    sums = cut.agg(F.sum("wanted").alias("n"), F.count("*").alias("c")).first()
    slots, cells = int(math.ceil(sums["n"])), max(256, sums["c"])
    drawn = schedule(spark, cut, slots, cells).groupBy("source_id").agg(F.count("*").alias("drawn"))
    d = positions(rows, ties=("_row1", "_row2")).join(drawn, "source_id").withColumn("blocks", F.greatest(blocks_of(block), F.lit(1)))
    edge = _first_of("(drawn % blocks)") - F.col("start")
    d = d.withColumn("_part", F.least(F.greatest(edge, F.lit(0)), F.col("size"))).withColumn("_whole", F.expr("drawn div blocks") + (F.col("_part") == F.col("size")).cast("int")).where("size > 0")
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("_whole").cast("int")), F.when((F.col("_part") > 0) & (F.col("_part") < F.col("size")), F.array("_part")).otherwise(F.array().cast("array<bigint>")))
    draws = d.select("_row1", "_row2", copies.alias("_draws")).where(F.size("_draws") > 0)
    texts = keyed.dropDuplicates(keys)
    d = texts.join(draws, (texts[keys[0]] == draws["_row1"]) & (texts[keys[1]] == draws["_row2"])).withColumn("_words", F.explode("_draws"))
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1), 1, F.col("_words").cast("int")), " ")
    new = {"text": F.when(F.col("_words") < 0, F.col("text")).otherwise(words)}
    if "n_chars" in cols:
        new["n_chars"] = F.when(F.col("_words") < 0, F.col("n_chars")).otherwise(F.length(words)).cast(docs.schema["n_chars"].dataType)
    return d.select(*[new[c].alias(c) if c in new else texts[c] for c in cols])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``, a row each; see ``mix`` for nulls, rows without words and empty tables."""
    return mix(table(spark, sf_dir, "documents"))
