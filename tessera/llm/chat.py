"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns of a conversation are laid out by a template and cut into windows by
prefix sums of their tokens: a turn opens a new window where the sum before it
passes a multiple of the stride. A later window opens with the system turn
and a limited history, the turns right before it, which are shown but masked:
each assistant text is under the loss mask once, where it is new.

A backslash follows every backslash, ``<`` and ``[`` of a role or text, and
every line feed of a role, so that no control string can stand inside one; a
backslash and the character it follows are read back as that character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import table

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Tokens: a window's budget, the share of it that history may repeat, the characters that count as one token.
BUDGET, HISTORY, CHARS = 2048, 512, 4


def escaped(c: Column, more: str = "") -> Column:
    return F.regexp_replace(c, rf"([\\<\[{more}])", r"$1\\")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)([\\<\[\n])\\", "$1")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, repeated, loss, tokens, over): ``repeated`` turns open the text; ``loss`` lists (start, length) in code points.

    Turns come by ``turn``, ties by role and text; null roles and texts are
    empty. The stride is half of what the system turn and history leave of
    the budget. Turns up to a stride share windows; a longer one has a window
    of its own, which repeats no more history than the budget leaves. Turns
    are never cut: a window is over the budget, and marked, only if one turn
    is with the system turn, or the system turn leaves less than two tokens.
    Extra columns are ignored, repeated rows are turns of their own; an empty
    table gives no rows.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("head", F.concat(F.lit(OPEN), escaped(F.col("role"), r"\n"), F.lit("\n"))).withColumn("body", escaped(F.col("text")))
    t = t.withColumn("piece", F.concat("head", "body", F.lit(CLOSE))).withColumn("tokens", F.ceil(F.length("piece") / CHARS))
    t = t.select("conv_id", "turn", "role", "text", "piece", "tokens", F.length("head").alias("at"), F.length("body").alias("chars"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("i", F.row_number().over(order))
    t = t.withColumn("before", F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    first = F.first(F.struct("role", "piece", "tokens")).over(order.rowsBetween(W.unboundedPreceding, 0))
    t = t.withColumn("system", F.when(first["role"] == "system", first))
    shown_always = F.coalesce(F.col("system.tokens"), F.lit(0))
    stride = F.floor((budget - history - F.least(shown_always, F.lit(budget - history - 2))) / 2)
    t = t.withColumn("cell", F.floor(F.col("before") / stride)).withColumn("long", F.col("tokens") > stride)
    back = [F.lag(F.struct("piece", "tokens"), k).over(order) for k in (1, 2)]
    t = t.select("*", F.lag(F.struct("cell", "long")).over(order).alias("was"), back[0].alias("one"), back[1].alias("two"))
    opens = F.col("was").isNotNull() & ((F.col("was.cell") != F.col("cell")) | F.col("long") | F.col("was.long"))
    t = t.withColumn("opens", opens)
    t = t.withColumn("window", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    oldest = F.when(F.col("system").isNotNull(), 2).otherwise(1)
    room = F.when(F.col("long"), F.least(F.lit(history), budget - shown_always - F.col("tokens"))).otherwise(history)
    has_one = (F.col("i") - 1 >= oldest) & (F.col("one.tokens") <= room)
    has_two = has_one & (F.col("i") - 2 >= oldest) & (F.col("one.tokens") + F.col("two.tokens") <= room)
    opens = F.col("opens")

    def shown(piece: str, when: Column) -> Column:
        return F.when(when, F.struct(F.col(f"{piece}.piece").alias("piece"), F.lit(False).alias("new"), F.col(f"{piece}.tokens").alias("tokens")))

    items = F.array(
        shown("system", opens & F.col("system").isNotNull()), shown("two", opens & has_two), shown("one", opens & has_one),
        F.struct(F.col("piece"), F.lit(True).alias("new"), F.col("tokens")),
    )
    t = t.select("conv_id", "window", "i", "role", "at", "chars", F.posexplode(F.filter(items, lambda x: x.isNotNull())).alias("k", "item"))
    inside = W.partitionBy("conv_id", "window").orderBy("i", "k").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("from", F.coalesce(F.sum(F.length("item.piece")).over(inside), F.lit(0)))
    target = F.col("item.new") & (F.col("role") == "assistant")
    row = F.struct("i", "k", F.col("item.piece").alias("piece"), F.col("item.new").alias("new"), target.alias("target"), (F.col("from") + F.col("at")).cast("int").alias("start"), "chars")
    # the groups' key begins with conv_id, by which the rows are dealt already
    g = t.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.sum("item.tokens").alias("tokens"))
    loss = F.transform(F.filter("rows", lambda r: r["target"]), lambda r: F.struct(r["start"].alias("start"), r["chars"].alias("length")))
    return g.select(
        "conv_id", "window", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.size(F.filter("rows", lambda r: ~r["new"])).alias("repeated"), loss.alias("loss"), "tokens", (F.col("tokens") > budget).alias("over"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation say, parsed from their text: turns, masked text, characters."""
    cut = F.split(F.col("formatted"), r"<\|end\|>\n")
    turns = F.transform(F.slice(cut, F.col("repeated") + 1, F.greatest(F.size(cut) - 1 - F.col("repeated"), F.lit(0))), lambda x: F.substr(x, F.lit(len(OPEN) + 1)))
    role = lambda x: F.regexp_extract(x, r"(?s)^((?:[^\\\n]|[\\\n]\\)*)\n", 1)
    plain = F.transform(turns, lambda x: F.concat(unescaped(role(x)), F.lit("\n"), unescaped(F.substr(x, F.length(role(x)) + 2)), F.lit("\n")))
    under = F.transform("loss", lambda s: unescaped(F.substr("formatted", s["start"] + 1, s["length"])))
    rows = formatted.select("conv_id", F.struct("window", F.size(turns).alias("n"), F.array_join(plain, "").alias("turns"), F.array_join(under, "").alias("loss"), F.length("formatted").alias("chars"), F.col("over").cast("long").alias("over")).alias("w"))
    g = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    total = lambda f: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[f])
    joined = lambda f: F.array_join(F.transform("w", lambda x: x[f]), "")
    return g.select(
        "conv_id", total("n").alias("n_turns"), F.sha2(F.encode(joined("turns"), "UTF-8"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(F.encode(joined("loss"), "UTF-8"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"), F.size("w").cast("long").alias("n_windows"), total("over").alias("n_over"),
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -1, whose texts are made of other templates' control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").union(probe)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and the probe, formatted and read back, a row per conversation; see ``windows`` for nulls, ties and long turns."""
    return read_back(windows(with_probe(table(spark, sf_dir, "conversations"))))
