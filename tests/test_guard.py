import datetime

import pytest
from pyspark.sql import functions as F

from tessera.streaming import guard as G
from tessera.streaming import state

T = datetime.datetime(2024, 1, 1)
PLAN = [("s1", "refs", "a"), ("s2", G.GATE, None), ("s3", "edit", None), ("s4", G.GATE, None), ("s5", "test", None)]


def at(seconds):
    return T + datetime.timedelta(seconds=seconds)


def call(task, seq, seconds, tool, arg=None):
    return (task, seq, at(seconds), "call", None, tool, arg)


def plan(task, seq, seconds, steps=PLAN):
    return (task, seq, at(seconds), "plan", steps, None, None)


EVENTS = [
    call("x", 0, 0, "edit"), plan("x", 1, 1), call("x", 2, 2, "edit"), call("x", 3, 3, "grep"), call("x", 4, 4, "refs", "b"), call("x", 5, 5, "refs", "a"), call("x", 6, 6, "refs", "a"), call("x", 7, 7, G.GATE),
    call("x", 8, 8, "edit"), call("x", 9, 9, "test"), call("x", 10, 1801, G.GATE), call("x", 11, 1802, "test"), call("x", 12, 1803, "test"),
    plan("y", 1, 0), plan("y", 2, 10, PLAN[2:]), call("y", 3, 11, "edit"), ("y", 4, at(12), "clear", None, None, None), call("y", 5, 13, "test"), plan("z", 1, 0, []), call("z", 2, 1, "edit"), call(None, 1, 0, "edit"), plan("w", 1, 0, None),
]
WANT = {
    ("x", 0): ("free", None, None, None), ("x", 2): ("blocked", "s3", "s2", "s1"), ("x", 3): ("free", None, None, None), ("x", 4): ("free", None, None, None), ("x", 5): ("allowed", "s1", None, None),
    ("x", 6): ("again", "s1", None, None), ("x", 7): ("allowed", "s2", None, None), ("x", 8): ("allowed", "s3", None, None), ("x", 9): ("blocked", "s5", "s4", "s4"), ("x", 10): ("allowed", "s4", None, None),
    ("x", 11): ("expired", None, None, None), ("x", 12): ("free", None, None, None), ("y", 3): ("allowed", "s3", None, None), ("y", 5): ("free", None, None, None), ("z", 2): ("free", None, None, None),
}


def told(df):
    return {(r["task"], r["seq"]): (r["verdict"], r["step"], r["gate"], r["next"]) for r in df.collect()}


def test_verdicts_of_a_table(spark):
    d = spark.createDataFrame(EVENTS, G.EVENT)
    assert told(G.guard_verdicts(d.withColumn("more", F.lit(1)))) == WANT
    assert told(G.guard_verdicts(d.limit(0))) == {}
    share = {r["task"]: (r["calls"], r["blocked"], r["expired"]) for r in G.blocked_share(G.guard_verdicts(d)).collect()}
    assert share["x"] == (12, 2, 1)


def test_a_stream_that_is_restarted_tells_the_same(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    d = spark.createDataFrame(EVENTS, G.EVENT)

    def run(part):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
        q = G.guard_stream(s).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(180)

    run(d.where(F.col("ts") < F.lit(at(6))))
    run(d.where(F.col("ts") >= F.lit(at(6))))  # a new query from the first one's checkpoint
    assert told(spark.read.parquet(str(tmp_path / "out"))) == WANT


@pytest.mark.parametrize("seconds,verdict", [(1800, "blocked"), (1801, "expired")])
def test_a_plan_holds_half_an_hour(spark, seconds, verdict):
    d = spark.createDataFrame([plan("t", 1, 0), call("t", 2, seconds, "edit")], G.EVENT)
    assert told(G.guard_verdicts(d))["t", 2][0] == verdict


def test_equal_plans_are_read_once(spark):
    from tessera.streaming import guard

    guard._plan.cache_clear()
    text = '[{"step":"s1","tool":"refs"},null,{"step":"s2","tool":"edit","arg":"x"}]'
    assert [guard._plan(text) for _ in range(3)] == [(("s1", "refs", ""), ("s2", "edit", "x"))] * 3 and guard._plan(None) == ()
    assert guard._plan.cache_info().misses == 2
