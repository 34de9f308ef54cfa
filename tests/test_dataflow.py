import pytest

from tessera.operators import dataflow as D
from tessera.operators import resolution as R
from tessera.sources import code, flows

KIND = "project string, path string, text string"


def reached(spark, text, name, string=D.STRING):
    f = spark.createDataFrame([("p", "a.py", text)], KIND)
    facts, rows = flows.facts(f), code.scan(f)
    moves = D.steps(facts, R.resolved(code.symbols(rows), code.edges(rows)))
    out = D.reached_parameters(facts, D.flow(moves, D.named_starts(facts, name), string))
    return {(r["fn"].split(":")[-1], r["param"]) for r in out.collect()}


BOTH = """
def same(x):
    return x

def save(secret, public):
    a = same(secret)
    b = same(public)
    store(a)
    show(b)

def store(v):
    pass

def show(w):
    pass
"""


def test_a_value_leaves_by_the_call_that_it_entered(spark):
    assert reached(spark, BOTH, "secret") == {("same", "x"), ("store", "v")}
    assert reached(spark, BOTH, "public") == {("same", "x"), ("show", "w")}
    assert reached(spark, BOTH, "x") == {("store", "v"), ("show", "w")}  # it began there: it leaves to all


def test_calls_beyond_the_string_leave_to_all(spark):
    chain = "".join(f"def f{k}(x{k}):\n    return f{k + 1}(x{k})\n" for k in range(4)) + "def f4(x4):\n    return x4\n" + "def other(o):\n    return f2(o)\n"
    text = chain + "def top(secret):\n    sink(f0(secret))\n\ndef sink(s):\n    pass\n"
    most = {(f"f{k}", f"x{k}") for k in range(5)} | {("sink", "s")}
    assert reached(spark, text, "secret", 9) == most
    assert reached(spark, text, "secret", 2) == most  # no less than the truth, whatever is forgotten


def test_recursion_ends(spark):
    text = "def down(n, acc):\n    if n:\n        return down(n, acc + n)\n    return acc\n\ndef go(secret):\n    out(down(secret, ''))\n\ndef out(o):\n    pass\n"
    assert reached(spark, text, "secret") == {("down", "n"), ("down", "acc"), ("out", "o")}


def test_types_that_carry_no_text_stop_a_value(spark):
    text = "def f(secret):\n    g(secret)\n    h(secret)\n    k(v=secret)\ndef g(n: int):\n    out(n)\ndef h(s: 'str | int'):\n    pass\ndef k(u, v: list[str]):\n    pass\ndef out(o):\n    pass\n"
    assert reached(spark, text, "secret") == {("h", "s"), ("k", "v")}
    assert reached(spark, text, "n") == {("out", "o")}


def test_ways_of_a_value(spark):
    text = """
class Box:
    def put(self, item, *, note=None):
        self.keep(item)
        return note
    def keep(self, thing):
        pass
def f(secret):
    a, (b, c) = 1, (secret, 2)
    d = [e for e in b]
    with open(d) as g:
        for h in g:
            if h == secret:
                one(h)
    two(secret == 1)
    three(f"{secret!r} and", lambda: secret)
    Box.put(1, secret)
    x = Box.put(None, note={'k': [secret]})
    four(x)
def one(p): pass
def two(q): pass
def three(r, s): pass
def four(t): pass
"""
    got = reached(spark, text, "secret")
    assert {("three", "r"), ("put", "note"), ("four", "t")} <= {(f.split(".")[-1], p) for f, p in got}
    assert ("two", "q") not in got and ("three", "s") not in got


@pytest.mark.parametrize("text", ["", "def (", "x = 1\n", "def f(): pass\n"])
def test_nothing_flows(spark, text):
    assert reached(spark, text, "secret") == set()


def test_no_table_of_names_or_steps_goes_to_the_driver(spark):
    files = spark.createDataFrame([("p", "a.py", "def f(x):\n    return g(x)\n\ndef g(y):\n    return y\n")], "project string, path string, text string")
    rows, facts = code.scan(files), flows.facts(files)
    resolved = R.resolved(code.symbols(rows), code.edges(rows))
    joined = [line for line in D.steps(facts, resolved.where("type = 'calls'"))._jdf.queryExecution().sparkPlan().toString().split("\n") if "BroadcastHashJoin" in line]
    assert not joined
