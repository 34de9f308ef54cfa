"""Data flow between functions by parameter, with bounded call strings.

A fact says that a value is in a variable of a function, and by which calls it
came there: the last ``STRING`` of them. A round takes the newest facts one
step -- along an assignment, into a call, out of a call -- in one equi-join,
and keeps what is new; it ends when nothing is. A value that entered by a call
leaves by that call alone, whoever else calls the function; only a value that
began in a function, or whose calls are longer than is kept, leaves to all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import written
from tessera.sources.flows import RESULT

#: Calls that a fact remembers.
STRING = 3
#: Types that carry no text.
NO_TEXT = [
    "int", "float", "bool", "complex", "bytes_literal",
    "Decimal", "datetime", "date", "time", "timedelta",
    "UUID", "uuid.UUID",
    "number", "boolean", "bigint", "Date", "symbol",
    "int32", "int64", "uint", "uint32", "uint64",
    "float32", "float64", "time.Time", "time.Duration",
]
_ANY = "*"


def carries(kind: Column) -> Column:
    """Whether a value of the type can carry text; of a union its first part counts, unknown types do."""
    root = F.trim(F.regexp_replace(F.split_part(kind, F.lit("|"), F.lit(1)), r"(?s)[\[<].*", ""))
    return kind.isNull() | ~F.coalesce(root, F.lit("")).isin(NO_TEXT)


def steps(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(project, fn, var, via, to_fn, to_var, call): how a value moves on.

    ``facts`` as ``flows.facts`` gives them; ``resolved`` is (project, source,
    target, found) of calls. ``via`` is empty for assignments and calls, else
    the call that a result leaves by; ``call`` is the one that is entered.
    """
    moves = facts.where("kind = 'move'").select("project", "fn", F.col("a").alias("var"), F.lit("").alias("via"), F.col("fn").alias("to_fn"), F.col("b").alias("to_var"), F.lit("").alias("call"))
    known = resolved.where("found is not null").select("project", F.col("source").alias("fn"), F.col("target").alias("b"), "found").distinct()
    passes = facts.where("kind = 'pass'").join(known.hint("merge"), ["project", "fn", "b"])
    params = facts.where("kind = 'param'").where(carries(F.col("b"))).select("project", F.col("fn").alias("found"), F.col("a").alias("param"), F.col("pos").alias("at"))
    call = F.concat("fn", "site")
    by = passes.where("a is not null").withColumn("key", F.coalesce("word", F.col("pos").cast("string")))
    names = params.select("project", "found", "param", F.explode(F.array_compact(F.array("param", F.col("at").cast("string")))).alias("key"))
    into = by.join(names.hint("merge"), ["project", "found", "key"]).select("project", "fn", F.col("a").alias("var"), F.lit("").alias("via"), F.col("found").alias("to_fn"), F.col("param").alias("to_var"), call.alias("call"))
    out = passes.select("project", F.col("found").alias("fn"), F.lit(RESULT).alias("var"), F.explode(F.array(call, F.lit(_ANY))).alias("via"), F.col("fn").alias("to_fn"), F.col("site").alias("to_var"), F.lit("").alias("call"))
    return moves.union(into).union(out).distinct()


def flow(moves: DataFrame, starts: DataFrame, string: int = STRING) -> DataFrame:
    """(project, start, start_var, fn, var, calls, depth): all that values of ``starts`` (project, fn, var) come to.

    ``moves`` is what ``steps`` gives. ``calls`` are the last calls on the way
    in, ``depth`` the least number of steps. Written round by round, dealt by
    (project, fn, var, via), in which the steps are written once. All that is
    joined is merged: these tables take many times their files' size in
    memory, by which a join would send them whole to the driver.
    """
    key = ["project", "fn", "var", "via"]
    moves = written(moves.repartition(*key).sortWithinPartitions(*key), "steps")
    fact = ["project", "start", "start_var", "fn", "var", "calls", "cut"]
    new = starts.select("project", F.col("fn").alias("start"), F.col("var").alias("start_var"), "fn", "var", F.array().cast("array<string>").alias("calls"), F.lit(False).alias("cut")).distinct()
    frontier = written(new.withColumn("depth", F.lit(0)), "facts")
    done, depth = [frontier], 0
    while True:
        depth += 1
        leaves = F.when(F.col("var") == RESULT, F.array(F.when(F.size("calls") > 0, F.element_at(F.concat(F.array(F.lit("")), F.col("calls")), -1)).otherwise(_ANY)))
        at = frontier.drop("depth").withColumn("via", F.explode(F.concat(F.array(F.lit("")), F.coalesce(leaves, F.array().cast("array<string>")))))
        j = at.join(moves.hint("merge"), key)
        entered, left = F.col("call") != "", F.col("via") != ""
        longer = F.concat("calls", F.array("call"))
        cut = F.size(longer) > string
        calls = F.when(entered, F.slice(longer, F.greatest(F.size(longer) - string, F.lit(0)) + 1, F.lit(string))).when(left & (F.size("calls") > 0), F.slice("calls", F.lit(1), F.size("calls") - 1)).otherwise(F.col("calls"))
        now = j.select("project", "start", "start_var", F.col("to_fn").alias("fn"), F.col("to_var").alias("var"), calls.alias("calls"), (F.col("cut") | (entered & cut)).alias("cut")).distinct()
        for seen in done:
            now = now.join(seen.select(*fact).hint("merge"), fact, "left_anti")
        frontier = written(now.withColumn("depth", F.lit(depth)), "facts")
        if frontier.isEmpty():
            break
        done.append(frontier)
        if len(done) > 8:  # long flows: what was seen becomes one table again
            every = done[0]
            for more in done[1:]:
                every = every.unionByName(more)
            done = [written(every, "facts")]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("project", "start", "start_var", "fn", "var", "calls", "depth")


def reached_parameters(facts: DataFrame, found: DataFrame) -> DataFrame:
    """(project, start, start_var, fn, param, depth) of what ``flow`` found: parameters of other functions, with the least steps to them."""
    params = facts.where("kind = 'param'").select("project", "fn", F.col("a").alias("var"))
    hit = found.where("fn <> start or var <> start_var").join(params.hint("merge"), ["project", "fn", "var"])
    return hit.groupBy("project", "start", "start_var", "fn", F.col("var").alias("param")).agg(F.min("depth").alias("depth"))


def named_starts(facts: DataFrame, name: str) -> DataFrame:
    """(project, fn, var): the parameters of that name, case aside."""
    return facts.where("kind = 'param'").where(F.lower("a") == name.lower()).select("project", "fn", F.col("a").alias("var"))
