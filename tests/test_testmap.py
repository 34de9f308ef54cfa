import random

from tessera.operators import conventions as C
from tessera.operators import testmap as T

PAIR = "project string, source string, test string, weight long"


def greedy(pairs):
    """The best pair of all, again and again; then each other test with the source of its best pair."""
    key = lambda r: (-r[3], abs(r[2].count("/") - r[1].count("/")), len(r[2]), r[2], r[1])
    rest, out = sorted(pairs, key=lambda r: (r[0], key(r))), []
    used = set()
    for p, s, t, w in rest:
        if (p, "s", s) not in used and (p, "t", t) not in used:
            used |= {(p, "s", s), (p, "t", t)}
            out.append((p, s, t, w, True))
    seen = set()
    for p, s, t, w in rest:
        if (p, "t", t) not in used and (p, t) not in seen:
            seen.add((p, t))
            out.append((p, s, t, w, False))
    return sorted(out)


def test_rounds_of_proposals_are_the_greedy_assignment(spark):
    rng = random.Random(9)
    pairs = {(rng.choice("pq"), f"{'a/' * rng.randrange(2)}s{rng.randrange(12)}.py", f"tests/{'b/' * rng.randrange(2)}t{rng.randrange(9)}.py"): rng.choice([1, 100, 100, 1000]) for _ in range(120)}
    rows = [(*k, w) for k, w in pairs.items()]
    got = T.assigned(spark.createDataFrame(rows, PAIR)).collect()
    assert sorted(map(tuple, got)) == greedy(rows)
    assert T.assigned(spark.createDataFrame([], PAIR)).count() == 0


def test_evidence_of_three_kinds(spark):
    files = spark.createDataFrame([("p", x) for x in ("src/a.py", "src/b.ts", "tests/test_a.py", "src/b.spec.ts", "Spec/deep/x.py", "go/y_test.go")], "project string, path string")
    imports = spark.createDataFrame([("p", "Spec/deep/x.py:file:x", "src/a.py:function:f"), ("p", "tests/test_a.py:file:test_a", "src/a.py:function:f"), ("p", "src/b.ts:file:b", "src/a.py:function:f"), ("p", "tests/test_a.py:file:t", None)], "project string, source string, found string")
    callers = spark.createDataFrame([("p", "src/a.py:function:f", f"Spec/deep/x.py:function:t{k}") for k in range(150)] + [("p", "tests/test_a.py:function:h", "Spec/deep/x.py:function:t")], "project string, symbol_id string, caller_id string")
    found = T.evidence(files, imports, callers)
    assert {(r["source"], r["test"]): r["weight"] for r in found.collect()} == {("src/a.py", "tests/test_a.py"): 1100, ("src/b.ts", "src/b.spec.ts"): 1000, ("src/a.py", "Spec/deep/x.py"): 199}
    symbols = spark.createDataFrame([("p", p, "function", "f") for p in ("src/a.py", "src/c.py")], "project string, path string, kind string, name string")
    assert [r["path"] for r in C.untested(symbols, T.tested(T.assigned(found))).collect()] == ["src/c.py"]
