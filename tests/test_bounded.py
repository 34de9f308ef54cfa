import datetime
import random

from pyspark.sql import functions as F

from tessera.streaming import bounded as B

T = datetime.datetime(2024, 1, 1)
KIND = "session string, ts timestamp"


def drawn(n, sessions, seed=1):
    rng = random.Random(seed)
    return [(f"s{int(rng.paretovariate(0.7)) % sessions}", T + datetime.timedelta(seconds=30 * k)) for k in range(n)]


def lru(events, most, ttl):
    """Sessions by time of last use, the oldest going first."""
    live = {}
    for s, t in events:
        live.pop(s, None)
        if len(live) >= most:
            live.pop(next(iter(live)))
        live[s] = t
    newest = events[-1][1]
    return {s for s, t in live.items() if (newest - t).total_seconds() <= ttl}


def test_what_is_kept_is_what_least_recently_used_keeps(spark):
    events = drawn(1500, 400)
    d = spark.createDataFrame(events + [(None, T), ("x", None)], KIND)
    for most, ttl in ((30, 10**9), (1000, 3600), (5, 60)):
        assert {r["session"] for r in B.live_sessions(d, most, ttl).collect()} == lru(events, most, ttl)
    kept, gone = B.live_sessions(d, 30), B.evicted_sessions(d, 30)
    assert kept.count() + gone.count() == len({s for s, _ in events}) and kept.join(gone, "session").count() == 0
    assert B.live_sessions(d.limit(0)).count() == 0


def test_a_stream_keeps_the_bound_within_its_error_and_restarts(spark, tmp_path):
    events = drawn(3000, 900, 2)
    for k in range(3):
        spark.createDataFrame(events[k * 1000 : (k + 1) * 1000], KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sessions = B.Sessions(f"file://{tmp_path}/live", most=50)

    def run():
        s = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = s.writeStream.foreachBatch(sessions.take).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(180)

    run()
    last = max(k for k in range(5) if sessions.read(spark, k) is not None)
    live = {r["session"] for r in sessions.read(spark, last).collect()}
    assert lru(events, 50, B.TTL) <= live and len(live) <= 50 * (1 + 1 / B.ACCURACY) + 2
    again = sessions.read(spark, last).orderBy("session").collect()
    part = spark.createDataFrame(events[2000:], KIND)
    sessions.take(part, last)  # the last batch once more, as after a restart
    assert sessions.read(spark, last).orderBy("session").select(*again[0].asDict()).collect() == again
    assert sessions.read(spark, last).agg(F.max("n")).first()[0] > 1
