import random

import pytest

from tessera.operators import resolution as R
from tessera.plans import stores
from tessera.sources import generations as G

KIND = "project string, path string, text string"


def rows(spark, root, generation=None):
    return {t: sorted(map(str, G.read(spark, root, t, generation).select(*[c.split()[0] for c in kind.split(", ")]).collect())) for t, kind in G.TABLES.items()}


def drawn(rng, names, module):
    """A file of a small language of imports, re-exports, classes, methods and calls."""
    some = lambda: rng.choice(names)
    lines = [f"from .{rng.choice(module)} import {some()}" for _ in range(rng.randrange(3))]
    if rng.random() < 0.3:
        return "\n".join(f"from .{rng.choice(module)} import {rng.choice([some(), '*'])}" for _ in range(2)) + "\n"
    for name in rng.sample(names, rng.randrange(1, 3)):
        if rng.random() < 0.3:
            lines.append(f"class {name.capitalize()}({some().capitalize()}):\n    def {some()}(self):\n        self.{some()}()\n")
        else:
            lines.append(f"def {name}(x):\n    {some()}(x)\n    {some()}.{some()}(x)\n")
    return "\n".join(lines) + "\n"


def project(seed, change):
    names, module = ["alpha", "beta", "gamma", "delta", "omega"], ["m0", "m1", "m2", "pkg"]
    out = []
    for p in ("p", "q"):
        rng = random.Random(f"{seed}-{p}-{change if p == 'p' else 0}")
        for path in ("m0.py", "m1.py", "m2.py", "pkg/__init__.py", "pkg/a.py", "app.py"):
            old = random.Random(f"{seed}-{p}-{path}")
            fate = rng.random() if change and p == "p" else 1
            if fate < 0.15:
                continue  # gone
            text = drawn(random.Random(f"{seed}-{path}-{change}") if fate < 0.4 else old, names, module)
            out.append((p, "moved/" + path if 0.4 <= fate < 0.5 else path, text))
        if change and p == "p" and rng.random() < 0.5:
            out.append((p, "new.py", drawn(rng, names, module)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_a_refresh_tells_what_a_rebuild_tells(spark, tmp_path, seed):
    root = f"file://{tmp_path}/kept"
    G.build(spark, root, spark.createDataFrame(project(seed, 0), KIND), buckets=4)
    for change in (1, 2):
        now = spark.createDataFrame(project(seed, change), KIND)
        assert G.refresh(spark, root, now) == change + 1
        fresh = f"file://{tmp_path}/fresh-{change}"
        G.build(spark, fresh, now, buckets=4)
        assert rows(spark, root) == rows(spark, fresh)
    assert G.refresh(spark, root, now) == 3  # nothing changed: no new generation


def test_only_touched_buckets_are_written_and_old_generations_stay(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    files = [("p", f"f{k}.py", f"def g{k}():\n    g{k + 1}()\n") for k in range(40)] + [("q", "f0.py", "def g0():\n    g7()\n")]
    G.build(spark, root, spark.createDataFrame(files, KIND), buckets=16)
    before = rows(spark, root)
    files[7] = ("p", "f7.py", "def renamed():\n    g8()\n")
    G.refresh(spark, root, spark.createDataFrame(files, KIND))
    assert rows(spark, root, 1) == before
    entries = G._manifest(spark, root, 2)
    moved = {t: {b for (x, b), g in entries.items() if x == t and g == 2} for t in G.TABLES}
    assert all(len(moved[t]) == 1 for t in ("files", "symbols", "edges"))  # the changed file's
    assert len(moved["resolved"]) <= 2  # and the one file's that calls what it declared
    got = {(r["project"], r["source"]): r["found"] for r in G.read(spark, root, "resolved").collect()}
    assert got["p", "f6.py:function:g6"] is None and got["p", "f5.py:function:g5"] == "f6.py:function:g6" and got["p", "f7.py:function:renamed"] == "f8.py:function:g8"


def test_the_pointer_moves_once(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    assert G.current(spark, root) is None
    with pytest.raises(ValueError):
        G.read(spark, root, "files")
    one = spark.createDataFrame([("p", "a.py", "def a(): pass\n"), ("p", "b.py", None)], KIND)
    assert G.refresh(spark, root, one) == 1
    with pytest.raises(RuntimeError):
        G._publish(spark, root, 1, {})
    assert G.read(spark, root, "files").count() == 1
    assert G.refresh(spark, root, one.limit(0)) == 2 and G.read(spark, root, "symbols").count() == 0


def test_affected_files(spark):
    s = spark.createDataFrame([("p", "a.py", "a.py:function:go", "function", "go", 1), ("p", "c.py", "c.py:method:K.run", "method", "K.run", 1)], "project string, path string, id string, kind string, name string, start_line int")
    e = spark.createDataFrame(
        [
            ("p", "x.py:function:f", "go", "calls", 1, []), ("p", "y.py:function:f", "k.run", "calls", 1, []), ("p", "z.py:function:f", "other", "calls", 1, []), ("q", "w.py:function:f", "go", "calls", 1, []),
            ("p", "pkg/__init__.py:file:__init__", "a", "re_exports", 1, ["*"]), ("p", "v.py:file:v", "pkg", "imports", 1, ["anything"]),
        ], "project string, source string, target string, type string, line int, names array<string>",
    )
    of = lambda *paths: {r["path"] for r in R.affected(s, e, spark.createDataFrame([("p", p) for p in paths], "project string, path string")).collect()}
    assert of("a.py") == {"a.py", "x.py"} and of("c.py") == {"c.py", "y.py"} and of("z.py") == {"z.py"} and of("pkg/__init__.py") == {"pkg/__init__.py", "v.py"}


def test_every_kind_of_edit_is_in_the_query(spark):
    f = stores.edited_files(spark, "/root/testdata/sf0.001")
    assert {"extra.py", "core2.py", "misc.py", "core.py"} <= {r["path"] for r in f.select("path").distinct().collect()}
