"""Conventions, module coverage and plans on small tables with known results."""

from pyspark.sql import functions as F

from tessera.operators import conventions as C

ROWS = [
    ("p", "a.py", "class", "Store", "", "", 1, 9, [], ""), ("p", "a.py", "method", "Store.get_all", "list[int]", "", 2, 5, ["x", "y"], "try: x\nexcept E: raise"),
    ("p", "b.py", "function", "loadUser", "list[str]", "uses logging", 1, 3, ["x"], ""), ("p", "b.py", "function", "save", "", "", 4, 6, [], "return {'error': 1}"),
    ("p", "api/c.py", "function", "__call__", "", "", 1, 2, [], ""), ("q", "d.py", "variable", "MAX_SIZE", "", "", 1, 1, [], ""), ("q", "d.py", "function", "x", "", "", 1, 1, [], ""),
]


def symbols(spark):
    return spark.createDataFrame(ROWS, "project string, path string, kind string, name string, returns string, summary string, start_line int, end_line int, params array<string>, content string")


def test_naming(spark):
    s = symbols(spark)
    got = {(r["project"], r["kind"], r["style"]): (r["n"], r["share"], r["rank"]) for r in C.naming(s).collect()}
    assert got == {
        ("p", "class", "PascalCase"): (1, 100.0, 1), ("p", "method", "snake_case"): (1, 100.0, 1), ("p", "function", "camelCase"): (1, 50.0, 1), ("p", "function", "lowercase"): (1, 50.0, 2),
        ("q", "variable", "UPPER_SNAKE"): (1, 100.0, 1),
    }
    n = spark.createDataFrame([("A_B",), ("HTTP",), ("Abc",), ("aB",), ("a_b",), ("a-b",), ("ab",), ("a",), ("a?b",)], "n string")
    assert [r[0] for r in n.select(C.style(F.col("n"))).collect()] == ["UPPER_SNAKE", "UPPER_SNAKE", "PascalCase", "camelCase", "snake_case", "kebab-case", "lowercase", None, None]


def test_patterns(spark):
    s = symbols(spark)
    assert sorted(map(tuple, C.returned(s).collect())) == [("p", "list", 2)]
    assert sorted(map(tuple, C.parameter_counts(s).collect())) == [("p", 1, 1), ("p", 2, 1)]
    e = spark.createDataFrame([("p", "../lib/x", "imports", ["a", "_b"]), ("p", "lib/x", "imports", ["a"]), ("p", "go", "calls", [])], "project string, target string, type string, names array<string>")
    assert sorted(map(tuple, C.imported(e).collect())) == [("p", "module", "../lib/x".lstrip("./"), 2), ("p", "name", "a", 2)]
    o = {r["project"]: r for r in C.organisation(s).collect()}
    assert o["p"]["files"] == 3 and o["p"]["patterns"] == {"functions_only": 2, "single_class_with_methods": 1} and o["p"]["symbols_per_file"] == 1.7
    err = {r["project"]: r for r in C.error_handling(s).collect()}
    assert (err["p"]["functions"], err["p"]["try_except"], err["p"]["raise_exception"], err["p"]["uses_logging"], err["p"]["error_dict_return"], err["p"]["uses_assert"]) == (4, 1, 1, 1, 1, 0)


def test_modules_and_tests(spark):
    s = symbols(spark)
    tested = spark.createDataFrame([("p", "a.py"), ("p", "a.py")], "project string, path string")
    assert sorted((r["path"], r["functions"], r["classes"], r["importance"]) for r in C.untested(s, tested).collect()) == [("b.py", 2, 0, "low"), ("d.py", 1, 0, "low")]
    assert {r["project"]: (r["modules"], r["covered"], r["rate"]) for r in C.coverage_rate(s, tested).collect()} == {"p": (2, 1, 50.0), "q": (1, 0, 0.0)}
    d = spark.createDataFrame([("x/user_api.py", 0, 0), ("core/z.py", 0, 0), ("utils/z.py", 0, 0), ("z.py", 6, 0), ("z.py", 0, 0)], "p string, f int, c int")
    assert [r[0] for r in d.select(C.importance(F.col("p"), F.col("f"), F.col("c"))).collect()] == ["high", "high", "medium", "medium", "low"]


def test_steps_before_their_gate(spark):
    plan = spark.createDataFrame([("t", "s1", 1, "search", False), ("t", "g1", 2, "gate", True), ("t", "s2", 3, "edit", False), ("t", "g2", 4, "gate", True), ("t", "s3", 5, "edit", False)], "task string, step string, place int, tool string, gate boolean")
    calls = spark.createDataFrame([("t", 1, "edit"), ("t", 2, "other"), ("t", 3, "gate"), ("t", 4, "edit"), ("u", 1, "edit")], "task string, seq int, tool string")
    assert sorted(map(tuple, C.early_steps(plan, calls).collect())) == [("t", 1, "s2", "g1"), ("t", 4, "s3", "g2")]
