from tessera.operators import contracts as K
from tessera.sources import schemas as S

FILES = "project string, path string, text string"
PY = """
from typing import Generic, Optional, TypeVar
T = TypeVar("T")
class Page(BaseModel, Generic[T]):
    items: list[T]
    next: Optional[str] = None
class Pair(BaseModel, Generic[A, B]):
    left: A
    right: B
class User(BaseModel):
    id: int
    name: str
    boss: Optional["User"]
    tags: dict[str, list[str]]
class Swap(BaseModel, Generic[B, A]):
    p: Pair[A, B]
"""
TS = """
export interface Page<T> {
  items: T[];
  next?: string;
}
export interface User {
  id: string;
  name: string | null;
  boss?: User;
  tags: Record<string, string[]>;
  age: number;
}
"""


def opened(spark, roots):
    m = S.models(spark.createDataFrame([("py", "m.py", PY.replace('"User"', "User")), ("ts", "m.ts", TS)], FILES)).cache()
    fields = m.select("project", "model", "field", "type", "optional")
    params = m.select("project", "model", "params").distinct()
    return K.leaves(spark.createDataFrame(roots, "project string, root string"), fields, params)


def found(df, project, root):
    return {(r["path"], r["type"], r["optional"]) for r in df.where(f"project = '{project}' and root = '{root}'").collect()}


def test_generic_nested_and_recursive_types_are_opened(spark):
    d = opened(spark, [("py", "Page[User]"), ("ts", "Page<User>"), ("py", "Swap[string, number]"), ("py", "User[] | null"), ("py", "string"), ("py", "Nowhere<User>"), ("py", "Page")])
    assert found(d, "py", "Page[User]") == {
        (".items[].id", "number", False), (".items[].name", "string", False), (".items[].boss", "@User", True), (".items[].tags{}[]", "string", False), (".next", "string", True),
    }
    assert (".items[].age", "number", False) in found(d, "ts", "Page<User>")
    assert found(d, "py", "Swap[string, number]") == {(".p.left", "number", False), (".p.right", "string", False)}  # arguments cross over
    assert ("[].id", "number", True) in found(d, "py", "User[] | null") and found(d, "py", "string") == {("", "string", False)}
    assert found(d, "py", "Nowhere<User>") == {("", "Nowhere<User>", False)} and (".items[]", "any", False) in found(d, "py", "Page")


def test_contracts_are_compared_by_path(spark):
    d = opened(spark, [("py", "Page[User]"), ("ts", "Page<User>"), ("ts", "any"), ("py", "User"), ("ts", "Page<any>")])
    c = spark.createDataFrame([("one", "py", "Page[User]", "ts", "Page<User>"), ("two", "py", "User", "ts", "any"), ("three", "py", "Page[User]", "ts", "Page<any>")], "contract string, project string, root string, caller_project string, caller_root string")
    got = {(r["contract"], r["path"], r["issue"]) for r in K.compared(c, d, d).collect()}
    assert got == {("one", ".items[].id", "type_mismatch"), ("one", ".items[].age", "missing_in_handler")}


def test_alternatives(spark):
    f = spark.createDataFrame([("p", "M", "a", "string | number", False), ("q", "M", "a", "number | string | boolean", False), ("q", "N", "a", "string", False), ("p", "N", "a", "string", True)], "project string, model string, field string, type string, optional boolean")
    none = spark.createDataFrame([], "project string, model string, params array<string>")
    d = K.leaves(spark.createDataFrame([("p", "M"), ("q", "M"), ("q", "N"), ("p", "N")], "project string, root string"), f, none)
    c = spark.createDataFrame([("fits", "p", "M", "q", "M"), ("not", "q", "M", "p", "M"), ("opt", "p", "N", "q", "N")], "contract string, project string, root string, caller_project string, caller_root string")
    assert {(r["contract"], r["issue"]) for r in K.compared(c, d, d).collect()} == {("not", "type_mismatch"), ("opt", "optionality_mismatch")}


def test_contracts_meet_by_merging_and_models_are_parsed_once(spark, monkeypatch):
    from tessera.operators import contracts
    from tessera.plans import tasks, texts
    from tests.oracle import SF

    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    written = contracts.written
    monkeypatch.setattr(contracts, "written", lambda df, label: plan(df) or written(df, label))
    plan(tasks.api_contracts(spark, SF))
    assert len(plans) > 8 and not [p for p in plans if "BroadcastHashJoin" in p]
    plan(texts.contract_drift(spark, SF))
    assert "MapInArrow" not in plans[-1] and "BroadcastHashJoin" not in plans[-1]
