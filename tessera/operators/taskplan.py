"""Plans of tasks: constraints from levels of risk, steps from constraints, and their order by what each needs.

Many tasks are planned at once: rules are rows or expressions over all of
them. The waves of a dependency relation come from repeated anti joins, and
what never becomes ready is reported as standing in, or behind, a circle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.shared import dealt_by, shares, written

#: Levels in their order, and what a dimension of at least a level asks for and forbids.
LEVELS = ["low", "medium", "high"]
CONSTRAINTS = [
    ("blast_radius", "medium", "must_run_impact_analysis"),
    ("breaking_risk", "medium", "must_use_edit_impact_preview"),
    ("test_risk", "medium", "must_add_or_update_tests"),
    ("cross_coupling", "medium", "must_check_cross_project_usage"),
    ("blast_radius", "high", "must_use_small_steps"),
    ("breaking_risk", "high", "must_request_human_review_on_public_contract_change"),
    ("test_risk", "high", "must_validate_before_wide_change"),
    ("cross_coupling", "high", "must_list_affected_projects"),
    ("complexity", "high", "must_review_dependency_chain"),
    ("rollback_difficulty", "high", "must_prepare_revert_plan"),
]
BLOCKED = [
    ("breaking_risk", "high", "rename_exported_symbol_without_review"),
    ("rollback_difficulty", "high", "multi_module_atomic_rewrite"),
    ("blast_radius", "high", "bulk_replace"),
]
INTENTS = {"cleanup": "must_verify_no_live_callers", "migration": "must_build_compatibility_layer"}
#: What an intent does to a symbol.
EDITS = {"refactor": "signature_change", "bugfix": "modify", "feature": "modify", "cleanup": "delete", "migration": "rename"}
#: Fixed value: symbols or files that get steps of their own.
ALONE = 10
#: What a phase needs: phase, what must be done, the constraint that asks for it (none: always), the code of its lack.
GATES = [
    ("plan_changes", "impact_analysis_done", "must_run_impact_analysis", "IMPACT_ANALYSIS_REQUIRED"),
    ("apply_changes", "cross_project_check_done", "must_check_cross_project_usage", "CROSS_PROJECT_CHECK_REQUIRED"),
    ("apply_changes", "tests_reviewed", "must_add_or_update_tests", "TEST_REVIEW_REQUIRED"),
    ("apply_changes", "human_review_completed", "must_request_human_review_on_public_contract_change", "HUMAN_REVIEW_REQUIRED_FOR_PUBLIC_CONTRACT_CHANGE"),
    ("expand_changes", "validation_passed", None, "VALIDATION_REQUIRED"),
    ("finalize", "validation_passed", None, "VALIDATION_REQUIRED"),
]
STEPS = "array<struct<place:int,step:string,tool:string,arg:string,required:boolean,needs:array<string>,wave:int>>"
DIMENSIONS = ["blast_radius", "breaking_risk", "test_risk", "cross_coupling", "complexity", "rollback_difficulty"]


def at_least(dimension: str, level: str) -> Column:
    return F.coalesce(F.col(dimension), F.lit("low")).isin(LEVELS[LEVELS.index(level) :])


def constraints(tasks: DataFrame) -> DataFrame:
    """``tasks`` (task, intent, a level for each of ``DIMENSIONS``) with ``constraints``, ``blocked`` (arrays) and ``max_files`` a step."""
    when = lambda rules: [F.when(at_least(d, level), F.lit(what)) for d, level, what in rules]
    said = when(CONSTRAINTS) + [F.when(F.col("intent") == i, F.lit(c)) for i, c in INTENTS.items()]
    high = {d: at_least(d, "high") for d in DIMENSIONS}
    strict, wide = high["blast_radius"] & high["test_risk"], high["breaking_risk"] & high["cross_coupling"]
    several = sum((h.cast("int") for h in high.values()), F.lit(0)) >= 2
    files = F.when(strict | wide, 1).when(several | high["blast_radius"], 2).when(at_least("blast_radius", "medium"), 3).otherwise(5)
    said.append(F.when(strict, F.lit("must_validate_before_wide_change")))
    blocked = [*when(BLOCKED), F.when(~strict & wide, F.lit("multi_module_atomic_rewrite"))]
    tidy = lambda cols: F.array_distinct(F.array_compact(F.array(*cols)))
    return tasks.withColumn("constraints", tidy(said)).withColumn("blocked", tidy(blocked)).withColumn("max_files", files)


def _ranked(tasks: DataFrame, targets: DataFrame) -> DataFrame:
    """``tasks`` with ``symbols`` and ``paths``: arrays of (k, arg, n), each the first ``ALONE`` + 1 of a task's and how many it has.

    Both orders and the tasks are dealt by task, so that a task's rows meet without another exchange.
    """
    key = shares(targets)
    nth = F.row_number().over(W.partitionBy("task").orderBy("first", "arg")) - 1
    every = F.count("*").over(W.partitionBy("task"))
    out = dealt_by(tasks, key, "task")
    for column, name in (("symbol", "symbols"), ("path", "paths")):
        named = targets.where(F.col("task").isNotNull() & F.col(column).isNotNull() & (F.col(column) != "")).select("task", "place", F.col(column).alias("arg"))
        named = dealt_by(named, key, "task")
        rows = named.groupBy("task", "arg", *([] if column == "path" else ["place"])).agg(F.min("place").alias("first"))
        rows = rows.select("task", "arg", nth.alias("k"), every.alias("n")).where(F.col("k") <= ALONE)
        out = out.join(rows.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("k", "arg", "n"))).alias(name)).hint("merge"), "task", "left")
    return out


def placed(tasks: DataFrame, targets: DataFrame) -> DataFrame:
    """(task, steps: array of place, step, tool, arg, required, needs, wave, in their order) of ``constraints``' tasks.

    ``targets`` are (task, place, symbol, path). Symbols and files up to
    ``ALONE`` get steps of their own; the rest of the symbols is one step. Low
    risk in all but rollback makes cleanups and bug fixes short. A task has
    few steps, so they are made, ordered and told their waves inside its row:
    a wave is one more than the last of the steps that ``needs`` names.
    """
    easy = ~at_least("blast_radius", "medium")
    for d in DIMENSIONS[1:5]:
        easy = easy & ~at_least(d, "medium")
    t = tasks.select("task", F.col("intent").isin("cleanup", "bugfix").alias("_small"), (F.col("intent") == "cleanup").alias("_clean"), (F.col("intent") != "feature").alias("_refers"), easy.alias("_easy"), *[at_least(d, "medium").alias(f"_{d}") for d in DIMENSIONS[1:5]], at_least("blast_radius", "medium").alias("_blast_radius"), at_least("complexity", "high").alias("_deep"))
    t = _ranked(t.withColumn("_short", F.coalesce(F.col("_easy") & F.col("_small"), F.lit(False))), targets)
    short, refers = F.col("_short"), F.coalesce(F.col("_refers"), F.lit(False))
    no, one = F.array().cast("array<string>"), F.lit(True)
    first_ref = lambda x: F.when(x["n"] == 1, "scope_callers").otherwise("scope_callers_0")
    own = lambda x, base: F.when(x["n"] == 1, base).otherwise(F.concat(F.lit(f"{base}_"), x["k"]))
    after = F.when(refers, 1).otherwise(0)

    def row(place, step, tool, arg, required, needs, wave):
        return F.struct(place.cast("int").alias("place"), step.alias("step"), F.lit(tool).alias("tool"), arg.alias("arg"), required.alias("required"), needs.alias("needs"), wave.cast("int").alias("wave"))

    #: rows, when, order in the phase, tool, purpose, required, needs, wave
    made = [
        ("symbols", lambda x: ~short & refers & (x["k"] < ALONE), 100, "find_references", lambda x: own(x, "scope_callers"), one, lambda x: no, F.lit(0)),
        ("symbols", lambda x: ~short & refers & (x["k"] == ALONE), 150, "impact_analysis", lambda x: F.lit("batch_scope_callers"), one, lambda x: no, F.lit(0)),
        ("symbols", lambda x: short & (x["k"] == 0) & F.col("_clean"), 100, "find_references", lambda x: F.lit("scope_callers"), one, lambda x: no, F.lit(0)),
        ("paths", lambda x: ~short & (x["k"] < ALONE), 200, "find_test_file", lambda x: own(x, "verify_test_coverage"), F.col("_test_risk"), lambda x: no, F.lit(0)),
        ("symbols", lambda x: ~short & (x["k"] == 0) & F.col("_cross_coupling"), 300, "find_references", lambda x: F.lit("check_cross_project"), one, lambda x: F.when(refers, F.array(first_ref(x))).otherwise(no), after),
        ("paths", lambda x: ~short & (x["k"] == 0) & F.col("_complexity"), 400, "dependency_graph", lambda x: F.lit("map_dependencies"), F.col("_deep"), lambda x: no, F.lit(0)),
        ("symbols", lambda x: ~short & (x["n"] <= ALONE), 500, "impact_analysis", lambda x: own(x, "assess_blast_radius"), F.col("_blast_radius"), lambda x: F.when(refers, F.array(own(x, "scope_callers"))).otherwise(no), after),
        ("symbols", lambda x: ~short & (x["k"] == 0) & (x["n"] > ALONE), 500, "impact_analysis", lambda x: F.lit("batch_assess_blast_radius"), F.col("_blast_radius"), lambda x: F.when(refers, F.array(first_ref(x))).otherwise(no), after),
        ("symbols", lambda x: ~short & (x["k"] == 0) & F.col("_breaking_risk"), 600, "edit_impact_preview", lambda x: F.lit("preview_change_risk"), one, lambda x: F.array(F.when(x["n"] == 1, "assess_blast_radius").when(x["n"] <= ALONE, "assess_blast_radius_0").otherwise("batch_assess_blast_radius")), after + 1),
    ]
    parts = []
    for rows, when, place, tool, purpose, required, needs, wave in made:
        step = lambda x: row(x["k"] + place, purpose(x), tool, x["arg"], required, needs(x), wave)  # noqa: B023, E731
        parts.append(F.coalesce(F.transform(F.filter(rows, when), step), F.array()).cast(STEPS))
    # generators keep the optimizer from copying what they give into every use of it
    t = t.select("task", "_short", F.explode(F.array(F.array_sort(F.concat(*parts)))).alias("_all"))
    t = t.select("task", "_short", "_all", F.explode(F.array(F.when(F.size("_all") == 0, 0).otherwise(F.array_max(F.transform("_all", lambda s: s["wave"])) + 1))).alias("_next"))
    plan = F.when(~short, F.array(row(F.lit(700), F.lit("gate_before_plan"), "task_gate_check", F.lit("plan_changes"), one, F.array_distinct(F.transform("_all", lambda s: s["step"])), F.col("_next")))).otherwise(F.array().cast(STEPS))
    last = row(F.lit(800), F.lit("gate_before_apply"), "task_gate_check", F.lit("apply_changes"), one, F.when(short, no).otherwise(F.array(F.lit("gate_before_plan"))), F.when(short, 0).otherwise(F.col("_next") + 1))
    return t.select("task", F.concat("_all", plan, F.array(last)).cast(STEPS).alias("steps"))


def steps(tasks: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps (task, place, step, tool, arg, required) and needs (task, step, needs) of ``placed``."""
    rows = placed(tasks, targets).select("task", F.explode("steps").alias("s")).select("task", "s.*")
    return rows.drop("needs", "wave"), rows.select("task", "step", F.explode("needs").alias("needs")).distinct()


def waves(nodes: DataFrame, needs: DataFrame, key: tuple[str, ...] = ("task",), node: str = "step") -> DataFrame:
    """``nodes`` with ``wave``: 0 for those that need nothing, else one more than the last of what they need; null for those in or behind a circle.

    ``needs`` are (key, node, needs); a need that is no node is none. A round
    takes away what is ready, by two anti joins, and is written.
    """
    k = [*key, node]
    live = written(nodes.select(*k).distinct(), "nodes")
    edges = needs.select(*k, "needs").distinct().join(live.withColumnRenamed(node, "needs"), [*key, "needs"], "left_semi")
    edges = written(edges, "needs")
    done, wave = None, 0
    while True:
        ready = live.join(edges.select(*k).distinct(), k, "left_anti").withColumn("wave", F.lit(wave))
        ready = written(ready, "ready")
        if ready.isEmpty():
            break
        done = ready if done is None else done.union(ready)
        gone = ready.select(*k)
        live = written(live.join(gone, k, "left_anti"), "nodes")
        edges = written(edges.join(gone.withColumnRenamed(node, "needs"), [*key, "needs"], "left_anti"), "needs")
        wave += 1
    if done is None:
        return nodes.withColumn("wave", F.lit(None).cast("int"))
    return nodes.join(done, k, "left")


def plans(tasks: DataFrame, targets: DataFrame) -> DataFrame:
    """(task, number, wave, step, tool, arg, required, gate) of every task, numbered in order; steps of one wave need not wait for one another."""
    rows = placed(constraints(tasks), targets).select("task", F.posexplode("steps").alias("at", "s")).select("task", (F.col("at") + 1).alias("number"), "s.*")
    return rows.select("task", "number", "wave", F.concat(F.lit("step_"), F.lpad(F.col("number").cast("string"), 2, "0"), F.lit("_"), "step").alias("step"), "tool", "arg", "required", (F.col("tool") == "task_gate_check").alias("gate"))


def gate_check(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """(task, phase, passed, reasons) of entering a phase. ``tasks`` have ``constraints``; ``states`` are (task, phase, done: array of what is done)."""
    s = states.join(tasks.select("task", "constraints"), "task")
    reasons = []
    for phase, what, asked, code in GATES:
        wanted = F.lit(True) if asked is None else F.array_contains("constraints", asked)
        reasons.append(F.when((F.col("phase") == phase) & wanted & ~F.coalesce(F.array_contains("done", what), F.lit(False)), F.lit(code)))
    found = F.array_distinct(F.array_compact(F.array(*reasons)))
    return s.select("task", "phase", (F.size(found) == 0).alias("passed"), found.alias("reasons"))
