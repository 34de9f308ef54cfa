import random

from tessera.operators import taskplan as P

TASK = "task long, intent string, blast_radius string, breaking_risk string, test_risk string, cross_coupling string, complexity string, rollback_difficulty string"
TARGET = "task long, place long, symbol string, path string"


def waves(spark, edges, nodes):
    n = spark.createDataFrame([(1, x) for x in nodes], "task long, step string")
    e = spark.createDataFrame([(1, a, b) for a, b in edges], "task long, step string, needs string")
    return {r["step"]: r["wave"] for r in P.waves(n, e).collect()}


def test_waves_and_circles(spark):
    assert waves(spark, [("b", "a"), ("c", "b"), ("c", "a"), ("c", "gone"), ("d", "d"), ("e", "f"), ("f", "e"), ("g", "f"), ("g", "a")], "abcdefgh") == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": None, "g": None, "h": 0}
    assert waves(spark, [("a", "b"), ("b", "a")], "ab") == {"a": None, "b": None} and waves(spark, [], "") == {}


def test_waves_against_longest_ways(spark):
    rng = random.Random(1)
    nodes = [f"n{k}" for k in range(30)]
    edges = [(nodes[a], nodes[b]) for a, b in (sorted(rng.sample(range(30), 2), reverse=True) for _ in range(50))]
    want = {}
    for n in nodes:
        want[n] = max((want[b] + 1 for a, b in edges if a == n), default=0)
    assert waves(spark, edges, nodes) == want


def planned(spark, tasks, targets):
    out = {}
    for r in P.plans(spark.createDataFrame(tasks, TASK), spark.createDataFrame(targets, TARGET)).orderBy("task", "number").collect():
        out.setdefault(r["task"], []).append((r["step"], r["tool"], r["arg"], r["required"], r["wave"]))
    return out


def test_plans(spark):
    low = ("low",) * 6
    tasks = [(1, "cleanup", *low), (2, "bugfix", *low), (3, "refactor", "high", "high", "low", "medium", "high", "low"), (4, "feature", "low", None, "medium", "low", "low", "low"), (5, "refactor", *low), (6, "refactor", *low)]
    targets = [(1, 1, "s", "f"), (3, 2, "s2", "f"), (3, 1, "s1", "f"), (4, 1, "s", "f"), *[(5, k, f"s{k:02}", None) for k in range(12)], (6, 1, None, "g"), (6, 2, "", "f")]
    got = planned(spark, tasks, targets)
    assert got[1] == [("step_01_scope_callers", "find_references", "s", True, 0), ("step_02_gate_before_apply", "task_gate_check", "apply_changes", True, 0)]
    assert [x[0] for x in got[2]] == ["step_01_gate_before_apply"]
    assert [(x[0][8:], x[4]) for x in got[3]] == [
        ("scope_callers_0", 0), ("scope_callers_1", 0), ("verify_test_coverage", 0), ("check_cross_project", 1), ("map_dependencies", 0), ("assess_blast_radius_0", 1), ("assess_blast_radius_1", 1), ("preview_change_risk", 2),
        ("gate_before_plan", 3), ("gate_before_apply", 4),
    ]
    assert [(x[0][8:], x[3], x[4]) for x in got[4]] == [("verify_test_coverage", True, 0), ("assess_blast_radius", False, 0), ("gate_before_plan", True, 1), ("gate_before_apply", True, 2)]
    names = [x[0][8:] for x in got[5]]
    assert names == [f"scope_callers_{k}" for k in range(10)] + ["batch_scope_callers", "batch_assess_blast_radius", "gate_before_plan", "gate_before_apply"] and got[5][10][2] == "s10"
    assert [x[2] for x in got[6]] == ["g", "f", "plan_changes", "apply_changes"]


def test_constraints_and_gates(spark):
    tasks = spark.createDataFrame([(1, "migration", "high", "high", "high", "high", "low", "high"), (2, "bugfix", "medium", "low", "low", "low", "low", "low"), (3, "x", *[None] * 6)], TASK)
    c = {r["task"]: r for r in P.constraints(tasks).collect()}
    assert c[1]["max_files"] == 1 and c[1]["blocked"] == ["rename_exported_symbol_without_review", "multi_module_atomic_rewrite", "bulk_replace"] and "must_build_compatibility_layer" in c[1]["constraints"]
    assert (c[2]["max_files"], c[2]["constraints"], c[2]["blocked"]) == (3, ["must_run_impact_analysis"], []) and (c[3]["max_files"], c[3]["constraints"]) == (5, [])
    states = spark.createDataFrame([(2, "plan_changes", None), (2, "plan_changes", ["impact_analysis_done"]), (3, "finalize", []), (3, "inspect", [])], "task long, phase string, done array<string>")
    got = sorted((r["task"], r["phase"], r["passed"], r["reasons"]) for r in P.gate_check(P.constraints(tasks), states).collect())
    assert got == [(2, "plan_changes", False, ["IMPACT_ANALYSIS_REQUIRED"]), (2, "plan_changes", True, []), (3, "finalize", False, ["VALIDATION_REQUIRED"]), (3, "inspect", True, [])]


def test_plans_are_made_in_one_pass_and_their_waves_are_those_of_their_needs(spark, monkeypatch):
    rng = random.Random(2)
    levels = ["low", "medium", "high", None]
    tasks = spark.createDataFrame([(k, rng.choice(["cleanup", "bugfix", "feature", "refactor", "migration"]), *([rng.choice(levels) for _ in range(6)] if k % 3 else ["low"] * 6)) for k in range(60)], TASK)
    targets = spark.createDataFrame([(rng.randrange(65), rng.randrange(9), rng.choice(["s", None, f"s{rng.randrange(20)}"]), rng.choice([f"f{rng.randrange(15)}", ""])) for _ in range(400)], TARGET)
    rows, needs = P.steps(P.constraints(tasks), targets)
    want = sorted((r["task"], r["place"], r["wave"], r["step"]) for r in P.waves(rows, needs).collect())
    for share in (None, 40):  # as it is, and dealt to many partitions
        with monkeypatch.context() as m:
            m.setattr(P, "written", lambda *a: 1 / 0)  # no table between
            m.setattr(P, "shares", lambda df: 0 if share is None else df.count() // share)
            got = sorted((r["task"], r["number"], r["wave"], r["step"][8:]) for r in P.plans(tasks, targets).collect())
        assert [(t, w, s) for t, _, w, s in got] == [(t, w, s) for t, _, w, s in want] and max(w for _, _, w, _ in want) == 4
