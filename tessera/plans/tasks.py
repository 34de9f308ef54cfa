"""Queries over tasks: verdicts of a guard, plans in order, sessions that a bound leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.shared import dealt, written
from tessera.operators import contracts as K
from tessera.operators import taskplan as P
from tessera.plans.registry import query
from tessera.sources import schemas as S
from tessera.sources.tables import load
from tessera.streaming import bounded as B
from tessera.streaming import guard as Gd

#: Steps of two plans: (step, tool, argument).
PLANS = {
    "a": [("s1", "refs", ""), ("s2", "impact", ""), ("s3", "task_gate_check", ""), ("s4", "edit", "x"), ("s5", "task_gate_check", ""), ("s6", "test", "")],
    "b": [("t1", "refs", ""), ("t2", "task_gate_check", ""), ("t3", "edit", "")],
}
TOOLS = ["refs", "impact", "task_gate_check", "edit", "test", "grep"]


def _steps(name):
    return F.array(*[F.struct(F.lit(s).alias("step"), F.lit(t).alias("tool"), F.lit(a).alias("arg")) for s, t, a in PLANS[name]])


def guarded_events(spark, sf):
    """Every order a task: its plan, a call six minutes after another for each of its lines, and for every seventh order a new plan among them."""
    o = load(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("task"), F.col("o_orderdate").cast("timestamp").alias("at"), "o_orderkey")
    steps = F.when(F.col("o_orderkey") % 2 == 0, _steps("a")).otherwise(_steps("b"))
    none = F.lit(None).cast("string")
    plan = o.select("task", F.lit(0).cast("long").alias("seq"), F.col("at").alias("ts"), F.lit("plan").alias("kind"), steps.alias("steps"), none.alias("tool"), none.alias("arg"))
    again = o.where("o_orderkey % 7 = 0").select("task", F.lit(100).cast("long"), F.col("at") + F.expr("interval 21 minutes"), F.lit("plan"), _steps("b"), none, none)
    l = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x"))  # noqa: E741
    tool = F.element_at(F.array(*map(F.lit, TOOLS)), (F.col("x.l_partkey") % 6 + 1).cast("int"))
    calls = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "task", F.col("l_linenumber").cast("long"), F.col("at") + F.make_dt_interval(mins=F.col("l_linenumber") * 6), F.lit("call"), F.lit(None).cast(steps_type()), tool, F.when(F.col("x.l_suppkey") % 2 == 0, "x").otherwise("y"),
    )
    return plan.union(again).union(calls)


def steps_type():
    return "array<struct<step:string,tool:string,arg:string>>"


def _literal(name):
    return "[" + ", ".join(f"{{'i': {i}, 'step': '{s}', 'tool': '{t}', 'arg': '{a}'}}" for i, (s, t, a) in enumerate(PLANS[name])) + "]"


@query(f"""
WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, min({{'p': l_partkey, 's': l_suppkey}}) AS x FROM lineitem GROUP BY 1, 2),
e AS (
  SELECT o_orderkey::VARCHAR AS task, 0 AS seq, o_orderdate AS ts, CASE o_orderkey % 2 WHEN 0 THEN {_literal('a')} ELSE {_literal('b')} END AS plan, NULL::VARCHAR AS tool, NULL::VARCHAR AS arg FROM orders UNION ALL
  SELECT o_orderkey::VARCHAR, 100, o_orderdate + INTERVAL 21 MINUTE, {_literal('b')}, NULL, NULL FROM orders WHERE o_orderkey % 7 = 0 UNION ALL
  SELECT l_orderkey::VARCHAR, l_linenumber, o_orderdate + INTERVAL 6 MINUTE * l_linenumber, NULL, {TOOLS}[1 + x.p % 6], CASE x.s % 2 WHEN 0 THEN 'x' ELSE 'y' END FROM l JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts, seq) AS n FROM e),
g(task, n, seq, plan, since, done, called, verdict, step, gate, next) AS (
  SELECT task, 0::BIGINT, 0, CASE WHEN false THEN {_literal('a')} END, NULL::TIMESTAMP, []::INT[], false, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM (SELECT DISTINCT task FROM e)
  UNION ALL
  SELECT task, n, seq, CASE WHEN new IS NOT NULL THEN new WHEN verdict = 'expired' THEN NULL ELSE plan END, CASE WHEN new IS NOT NULL THEN ts WHEN verdict = 'expired' THEN NULL ELSE since END,
    CASE WHEN new IS NOT NULL OR verdict = 'expired' THEN [] WHEN verdict = 'allowed' THEN list_append(done, m.i) ELSE done END, new IS NULL, verdict, CASE WHEN verdict IN ('blocked', 'allowed', 'again') THEN m.step END,
    CASE verdict WHEN 'blocked' THEN open.step END, CASE verdict WHEN 'blocked' THEN list_filter(plan, lambda p: NOT list_contains(done, p.i))[1].step END
  FROM (
    SELECT *, CASE WHEN new IS NOT NULL THEN NULL WHEN since IS NULL THEN 'free' WHEN ts - since > INTERVAL 1800 SECOND THEN 'expired' WHEN m IS NULL THEN 'free' WHEN open IS NOT NULL THEN 'blocked' WHEN list_contains(done, m.i) THEN 'again' ELSE 'allowed' END AS verdict
    FROM (
      SELECT *, list_filter(plan, lambda p: p.tool = 'task_gate_check' AND NOT list_contains(done, p.i) AND p.i < m.i)[1] AS open FROM (
        SELECT g.task, n.n, n.seq, n.ts, n.plan AS new, g.plan, g.since, g.done,
          coalesce(list_filter(g.plan, lambda p: p.tool = n.tool AND (p.arg = '' OR p.arg = n.arg) AND NOT list_contains(g.done, p.i))[1], list_filter(g.plan, lambda p: p.tool = n.tool AND (p.arg = '' OR p.arg = n.arg))[1]) AS m
        FROM g JOIN n ON n.task = g.task AND n.n = g.n + 1))))
SELECT task, seq::BIGINT AS seq, verdict, step, gate, next FROM g WHERE called
""")
def guard_verdicts(spark, sf):
    """What a guard says of every call of every order's task."""
    return Gd.guard_verdicts(guarded_events(spark, sf))


def _levels(place):
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.expr(f"o_custkey div {3**place}") % 3 + 1).cast("int"))


def planned_tasks(spark, sf):
    """Every order a task of some intent and levels of risk; its lines name the symbols and files that it touches."""
    o = load(spark, sf, "orders")
    intent = F.element_at(F.array(*map(F.lit, ["refactor", "bugfix", "feature", "cleanup", "migration"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    easy = F.col("o_orderkey") % 4 == 0
    tasks = o.select(F.col("o_orderkey").alias("task"), intent.alias("intent"), *[F.when(easy, "low").otherwise(_levels(k)).alias(d) for k, d in enumerate(P.DIMENSIONS)])
    l = load(spark, sf, "lineitem")  # noqa: E741
    targets = l.select(F.col("l_orderkey").alias("task"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("place"), F.concat(F.lit("s"), "l_partkey").alias("symbol"), F.concat(F.lit("f"), "l_suppkey").alias("path"))
    return tasks, targets


@query("""
WITH RECURSIVE o AS (
  SELECT o_orderkey AS task, ['refactor', 'bugfix', 'feature', 'cleanup', 'migration'][1 + o_orderkey % 5] AS intent, [CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE (o_custkey // (3 ** k)::BIGINT) % 3 END FOR k IN range(6)] AS d FROM orders),
t AS (SELECT *, list_max(d[:5]) = 0 AND intent IN ('cleanup', 'bugfix') AS short, intent <> 'feature' AS refers FROM o),
g AS (SELECT DISTINCT l_orderkey AS task, l_linenumber * 1000000 + l_partkey AS place, 's' || l_partkey AS symbol, 'f' || l_suppkey AS path FROM lineitem),
s AS (SELECT task, arg, row_number() OVER (PARTITION BY task ORDER BY place, arg) - 1 AS k, count(*) OVER (PARTITION BY task) AS n FROM (SELECT DISTINCT task, place, symbol AS arg FROM g)),
f AS (SELECT task, arg, row_number() OVER (PARTITION BY task ORDER BY place, arg) - 1 AS k, count(*) OVER (PARTITION BY task) AS n FROM (SELECT task, path AS arg, min(place) AS place FROM g GROUP BY 1, 2)),
st AS (SELECT s.*, t.* EXCLUDE task, CASE WHEN n = 1 THEN '' ELSE '_' || k END AS x, CASE WHEN n = 1 THEN '' ELSE '_0' END AS z FROM s JOIN t USING (task)),
ft AS (SELECT f.*, t.* EXCLUDE task, CASE WHEN n = 1 THEN '' ELSE '_' || k END AS x FROM f JOIN t USING (task)),
p AS (
  SELECT task, 100 + k AS place, 'scope_callers' || x AS step, 'find_references' AS tool, arg, true AS required, []::VARCHAR[] AS needs FROM st WHERE NOT short AND refers AND k < 10 UNION ALL
  SELECT task, 160, 'batch_scope_callers', 'impact_analysis', arg, true, [] FROM st WHERE NOT short AND refers AND k = 10 UNION ALL
  SELECT task, 100, 'scope_callers', 'find_references', arg, true, [] FROM st WHERE short AND k = 0 AND intent = 'cleanup' UNION ALL
  SELECT task, 200 + k, 'verify_test_coverage' || x, 'find_test_file', arg, d[3] > 0, [] FROM ft WHERE NOT short AND k < 10 UNION ALL
  SELECT task, 300, 'check_cross_project', 'find_references', arg, true, CASE WHEN refers THEN ['scope_callers' || z] ELSE [] END FROM st WHERE NOT short AND k = 0 AND d[4] > 0 UNION ALL
  SELECT task, 400, 'map_dependencies', 'dependency_graph', arg, d[5] > 1, [] FROM ft WHERE NOT short AND k = 0 AND d[5] > 0 UNION ALL
  SELECT task, 500 + k, 'assess_blast_radius' || x, 'impact_analysis', arg, d[1] > 0, CASE WHEN refers THEN ['scope_callers' || x] ELSE [] END FROM st WHERE NOT short AND n <= 10 UNION ALL
  SELECT task, 500, 'batch_assess_blast_radius', 'impact_analysis', arg, d[1] > 0, CASE WHEN refers THEN ['scope_callers_0'] ELSE [] END FROM st WHERE NOT short AND n > 10 AND k = 0 UNION ALL
  SELECT task, 600, 'preview_change_risk', 'edit_impact_preview', arg, true, [CASE WHEN n <= 10 THEN 'assess_blast_radius' || z ELSE 'batch_assess_blast_radius' END] FROM st WHERE NOT short AND k = 0 AND d[2] > 0),
a AS (
  SELECT * FROM p UNION ALL
  SELECT task, 700, 'gate_before_plan', 'task_gate_check', 'plan_changes', true, (SELECT coalesce(list(step), []) FROM p WHERE p.task = t.task) FROM t WHERE NOT short UNION ALL
  SELECT task, 800, 'gate_before_apply', 'task_gate_check', 'apply_changes', true, CASE WHEN short THEN [] ELSE ['gate_before_plan'] END FROM t),
e AS (SELECT task, step, unnest(needs) AS needs FROM a),
w(task, step, wave) AS (SELECT task, step, 0 FROM a WHERE len(needs) = 0 UNION SELECT e.task, e.step, wave + 1 FROM w JOIN e ON e.task = w.task AND e.needs = w.step),
m AS (SELECT task, step, max(wave) AS wave FROM w GROUP BY 1, 2),
r AS (SELECT a.*, wave, row_number() OVER (PARTITION BY task ORDER BY place) AS number FROM a JOIN m USING (task, step))
SELECT task, number::INT AS number, wave, 'step_' || lpad(number::VARCHAR, 2, '0') || '_' || step AS step, tool, arg, required, tool = 'task_gate_check' AS gate FROM r
""")
def task_plan(spark, sf):
    """The ordered steps of every order's task, with gates, and the wave in which each can be taken."""
    return P.plans(*planned_tasks(spark, sf))


@query("""
WITH o AS (SELECT o_orderkey AS task, o_orderkey % 5 AS i, o_orderkey % 4 = 0 AS easy, [CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE (o_custkey // (3 ** k)::BIGINT) % 3 END FOR k IN range(6)] AS d FROM orders)
SELECT task, list_contains(d, 2) AND d[1] = 2 AS bulk, CASE WHEN d[1] = 2 AND d[3] = 2 OR d[2] = 2 AND d[4] = 2 THEN 1 WHEN len(list_filter(d, lambda x: x = 2)) >= 2 OR d[1] = 2 THEN 2 WHEN d[1] = 1 THEN 3 ELSE 5 END AS max_files,
  NOT ((d[4] >= 1 AND task % 3 <> 0) OR d[3] >= 1 OR d[2] = 2) AS passed,
  list_filter([CASE WHEN d[4] >= 1 AND task % 3 <> 0 THEN 'CROSS_PROJECT_CHECK_REQUIRED' END, CASE WHEN d[3] >= 1 THEN 'TEST_REVIEW_REQUIRED' END, CASE WHEN d[2] = 2 THEN 'HUMAN_REVIEW_REQUIRED_FOR_PUBLIC_CONTRACT_CHANGE' END], lambda x: x IS NOT NULL) AS reasons FROM o
""")
def task_gates(spark, sf):
    """Whether every order's task may apply its changes; every third has checked other projects."""
    tasks = P.constraints(planned_tasks(spark, sf)[0])
    done = F.when(F.col("task") % 3 == 0, F.array(F.lit("cross_project_check_done"))).otherwise(F.array().cast("array<string>"))
    gates = P.gate_check(tasks, tasks.select("task", F.lit("apply_changes").alias("phase"), done.alias("done")))
    return gates.join(tasks.select("task", F.array_contains("blocked", "bulk_replace").alias("bulk"), "max_files"), "task").select("task", "bulk", "max_files", "passed", "reasons")


@query("""
WITH s AS (SELECT user_id AS session, max(ts) AS last, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1),
f AS (SELECT * FROM s WHERE (SELECT max(last) FROM s) - last <= INTERVAL 86400 SECOND ORDER BY last DESC, session LIMIT 20)
SELECT * FROM s WHERE session NOT IN (SELECT session FROM f)
""")
def evicted_sessions(spark, sf):
    """The users whose sessions go if only twenty are kept, and none for over a day."""
    e = load(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"))
    return B.evicted_sessions(e, 20).withColumn("last", F.col("last").cast("timestamp_ntz"))


def contract_tables(spark, sf):
    """Every supplier's handler answers with a page of its model, every caller of it expects one; models nest, refer to themselves and take arguments."""
    s = dealt(load(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n")))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    k = F.col("k").cast("string")
    py = text(
        "class Page(BaseModel, Generic[T]):\n    items: list[T]\n    total: int\n\nclass Model", k, "(BaseModel):\n    id: ", F.when(F.col("n") % 2 == 0, "int").otherwise("str"), "\n    parent: Optional[Model", k,
        "]\n    marks: dict[str, list[Mark]]\n\nclass Mark(BaseModel):\n    at: int\n    note: Optional[str]\n",
    )
    ts = text(
        "export interface Page<T> {\n  items: T[];\n  total: number;\n}\nexport interface Model", k, " {\n  id: number;\n  parent?: Model", k, ";\n  marks: Record<string, Mark[]>;\n", F.when(F.col("n") % 3 == 0, "  extra: string;\n").otherwise(""),
        "}\nexport interface Mark {\n  at: number;\n  note", F.when(F.col("n") % 5 == 0, "").otherwise("?"), ": string;\n}\n",
    )
    files = s.select(F.concat(F.lit("py"), "k").alias("project"), F.lit("m.py").alias("path"), py.alias("text")).union(s.select(F.concat(F.lit("ts"), "k"), F.lit("m.ts"), ts))
    root = lambda o, c: F.concat(F.lit(f"Page{o}Model"), "k", F.lit(c))
    return files, s.select(F.col("k").alias("contract"), F.concat(F.lit("py"), "k").alias("project"), root("[", "]").alias("root"), F.concat(F.lit("ts"), "k").alias("caller_project"), root("<", ">").alias("caller_root"))


@query("""
SELECT s_suppkey AS contract, '.items[].id' AS path, 'type_mismatch' AS issue, 'error' AS severity FROM supplier WHERE s_nationkey % 2 = 1 UNION ALL
SELECT s_suppkey, '.items[].extra', 'missing_in_handler', 'error' FROM supplier WHERE s_nationkey % 3 = 0 UNION ALL
SELECT s_suppkey, '.items[].marks{}[].note', 'optionality_mismatch', 'warning' FROM supplier WHERE s_nationkey % 5 = 0
""")
def api_contracts(spark, sf):
    """What every supplier's handler gives against what its caller expects, by the paths of opened types."""
    files, contracts = contract_tables(spark, sf)
    found = written(S.models(files), "models")
    fields, params = S.inherited(found), found.select("project", "model", "params").distinct()
    given = K.leaves(contracts.select("project", "root"), fields, params)
    expected = K.leaves(contracts.select(F.col("caller_project").alias("project"), F.col("caller_root").alias("root")), fields, params)
    return K.compared(contracts, given, expected)
