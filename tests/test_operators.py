from pyspark.sql import functions as F

from tessera.functions.text import lines, naming_style, normalised_url, tokens
from tessera.operators import changes, graph, history, intervals, quality, search
from tessera.streaming import sessions


def test_tokens(spark):
    d = spark.createDataFrame([("useAuthToken",), ("HTMLParser get_user_by_id",), ("a b",), (None,)], "t string")
    assert [r[0] for r in d.select(tokens(F.col("t"))).collect()] == [["use", "auth", "token"], ["html", "parser", "get", "user", "by", "id"], [], []]


def test_lines_and_names(spark):
    d = spark.createDataFrame([("a\n\nb",), ("",)], "t string")
    assert [r[0] for r in d.select(lines(F.col("t"))).collect()] == [["a", "", "b"], [""]]
    n = spark.createDataFrame([("A_B",), ("AbcDef",), ("abcDef",), ("a_b",), ("a-b",), ("abc",), ("?",)], "n string")
    assert [r[0] for r in n.select(naming_style(F.col("n"))).collect()] == ["UPPER_SNAKE", "PascalCase", "camelCase", "snake_case", "kebab-case", "lowercase", "other"]
    u = spark.createDataFrame([("/a/${id}/b/?x=1#y",)], "u string")
    assert u.select(normalised_url(F.col("u"))).first()[0] == "/a/*/b"


def test_bm25_counts_repeated_query_terms(spark):
    d = spark.createDataFrame([(1, "login form"), (2, "login login token"), (3, None)], "id long, text string")
    one = {r["id"]: r["score"] for r in search.bm25(d, "id", "text", ["login"]).collect()}
    two = {r["id"]: r["score"] for r in search.bm25(d, "id", "text", ["login", "login"]).collect()}
    assert set(one) == {1, 2} and one[2] > one[1]
    assert abs(two[1] - 2 * one[1]) < 1e-5
    assert search.bm25(d, "id", "text", []).count() == 0


def test_graph(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "b"), ("d", "b")], "source string, target string")
    assert {(r["id"], r["level"]) for r in graph.impact(e, "a", 2).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 2)}
    assert {(r["symbol_id"], r["refs"]) for r in graph.reference_counts(e).collect()} == {("a", 1), ("b", 2), ("c", 1)}
    cyc = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "z")], "source string, target string")
    assert [tuple(r) for r in graph.two_cycles(cyc).collect()] == [("x", "y")]
    ab = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long")
    assert {tuple(r) for r in graph.components(ab).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}


def test_paths_end_at_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "source string, target string")
    s = spark.createDataFrame([("a",)], "id string")
    assert {(tuple(r["path"]), r["ended"]) for r in graph.simple_paths(e, s, 4).collect()} == {(("a", "b", "c"), "leaf")}


def test_history(spark):
    c = spark.createDataFrame([(k, p) for k in range(4) for p in ("x", "y")] + [(9, "x")], "commit long, path string")
    r = history.rules(c, 3, 0.3).collect()
    assert [(x["a"], x["b"], x["support"], x["confidence"], x["lift"]) for x in r] == [("x", "y", 4, 1.0, 1.0)]
    assert [tuple(x) for x in history.cochange(c, "x").collect()] == [("y", 4, 0.8)]


def test_intervals(spark):
    s = spark.createDataFrame([("f", 1, 10)], "key string, start long, end long")
    c = spark.createDataFrame([("f", p) for p in (1, 2, 5)], "key string, point long")
    assert sorted((r["start"], r["end"]) for r in intervals.uncovered(s, c, "key").collect()) == [(3, 4), (6, 10)]
    assert [(r["total"], r["covered"], r["pct"]) for r in intervals.coverage(s, c, "key").collect()] == [(10, 3, 30.0)]
    a = spark.createDataFrame([("f", 1, 200)], "key string, start long, end long")
    b = spark.createDataFrame([("f", 100, 300), ("f", 201, 202), ("g", 1, 2)], "key string, start long, end long")
    assert [(r["b_start"], r["b_end"]) for r in intervals.overlaps(a, b, "key").collect()] == [(100, 300)]


def test_changes(spark):
    o = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, h string")
    n = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "id long, h string")
    assert {tuple(r) for r in changes.detect_changes(o, n, "id", "h").collect()} == {(2, "modified"), (3, "deleted"), (4, "added")}


def test_duplicates(spark):
    text = "\n".join(f"line {k}" for k in range(6))
    d = spark.createDataFrame([(1, text), (2, "x\n" + text), (3, "other")], "id long, t string")
    r = quality.duplicate_blocks(quality.chunks(d, "id", "t", 6), "id").collect()
    assert [(x["copies"], x["files"], x["first_file"], x["first_line"]) for x in r] == [(2, 2, 1, 1)]


def test_sessions_as_a_stream(spark, tmp_path):
    e = spark.sql("select * from values ('u', timestamp'2024-01-01 00:00:00'), ('u', timestamp'2024-01-01 01:00:00'), ('u', timestamp'2024-01-05 00:00:00'), ('v', timestamp'2024-02-01 00:00:00') t(user, ts)")
    src = str(tmp_path / "in")
    e.write.parquet(src)
    stream = sessions.sessions(spark.readStream.schema(e.schema).parquet(src), "user", "ts", watermark="1 hour")
    q = stream.writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["user"], r["n"]) for r in spark.table("sess").collect()}
    assert got == {("u", 2), ("u", 1)}  # the last session is still open
    assert {(r["user"], r["n"]) for r in sessions.sessions(e, "user", "ts").collect()} == {("u", 2), ("u", 1), ("v", 1)}


def test_intervals_against_points(spark):
    import random

    rng = random.Random(4)
    span = lambda n: [(rng.choice("kl"), s, s + rng.choice([0, 1, 5, 40, 300])) for s in (rng.randrange(-200, 400) for _ in range(n))]
    a, b, points = span(25), span(25), [(rng.choice("klm"), rng.randrange(-200, 700)) for _ in range(300)]
    kind = "key string, start long, end long"
    d, e = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    got = sorted((r["key"], r["start"], r["end"], r["b_start"], r["b_end"]) for r in intervals.overlaps(d, e, "key").collect())
    assert got == sorted((k, s, t, u, v) for k, s, t in a for j, u, v in b if k == j and s <= v and u <= t)
    c = spark.createDataFrame(points, "key string, point long")
    all_ = {k: {x for j, s, t in a if j == k for x in range(s, t + 1)} for k in {k for k, _, _ in a}}
    seen = {k: {x for j, x in points if j == k} & all_[k] for k in all_}
    assert {(r["key"], r["total"], r["covered"]) for r in intervals.coverage(d, c, "key").collect()} == {(k, len(v), len(seen[k])) for k, v in all_.items()}
    lacking = {(r["key"], x) for r in intervals.uncovered(d, c, "key").collect() for x in range(r["start"], r["end"] + 1)}
    assert lacking == {(k, x) for k, v in all_.items() for x in v - seen[k]}
    runs = intervals.uncovered(d, c, "key").collect()
    assert all(r["n"] == r["end"] - r["start"] + 1 for r in runs) and not {(r["key"], r["end"] + 1) for r in runs} & {(r["key"], r["start"]) for r in runs}


def test_a_span_of_a_thousand_million_points_is_few_rows(spark):
    s = spark.createDataFrame([("k", 0, 10**9), ("k", 5, 6)], "key string, start long, end long")
    c = spark.createDataFrame([("k", 10), ("k", 10**9)], "key string, point long")
    assert sorted((r["start"], r["end"]) for r in intervals.uncovered(s, c, "key").collect()) == [(0, 9), (11, 10**9 - 1)]
    assert intervals.coverage(s, c, "key").first()["total"] == 10**9 + 1 and intervals.overlaps(s, s, "key").count() == 4
