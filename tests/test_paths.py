import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import paths as A

FILES = [
    "a/b.py", "a/__init__.py", "a/c/d.ts", "a/c/index.tsx", "a/c/index.js", "src/x.vue", "src/x.ts", "src/deep/y.mjs", "pkg/z.go", "pkg/y_test.go", "only/t_test.go", "root.ts", "a.service.ts", "src/e.f.ts",
]


def probe(candidate):
    """The definition: the path itself, with extensions, as a folder."""
    exts = [".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".go"]
    if candidate in FILES:
        return candidate
    head, _, base = candidate.rpartition("/")
    stem = base.rpartition(".")[0] if "." in base[1:] else base
    for e in exts:
        p = f"{head}/{stem}{e}" if head else stem + e
        if p in FILES:
            return p
    for i in ("index.ts", "index.tsx", "index.js", "index.jsx", "__init__.py"):
        p = f"{candidate}/{i}" if candidate else i
        if p in FILES:
            return p
    return None


def answers(spark, asked, aliases=(), modules=()):
    f = spark.createDataFrame([("p", x) for x in FILES] + [("q", "a/b.py"), ("p", None)], "project string, path string")
    i = spark.createDataFrame([("p", at, m, 1) for at, m in asked], "project string, path string, module string, line int")
    al = spark.createDataFrame([("p", *a) for a in aliases], "project string, prefix string, target string, exact boolean")
    mo = spark.createDataFrame([("p", m) for m in modules], "project string, prefix string")
    return {(r["path"], r["module"]): (r["found"], r["stage"]) for r in A.resolve(i, f, al, mo).collect()}


def test_relative_paths_against_the_definition(spark):
    asked = [
        ("a/c/k.ts", "./d"), ("a/c/k.ts", "./d.js"), ("a/c/k.ts", "../b"), ("a/c/k.ts", ".."), ("a/c/k.ts", "../../root"), ("a/c/k.ts", "../../../root"), ("a/c/k.ts", "./"), ("k.ts", "./src/x"),
        ("k.ts", "./a/c"), ("k.ts", "./src/deep/../x.vue"), ("k.ts", "./a.service"), ("k.ts", "./src/e.f"), ("a/k.py", ".b"), ("a/c/k.py", "..b"), ("a/c/k.py", "..c.d"), ("a/k.py", "."), ("a/c/k.py", "...root"),
    ]

    def want(at, m):
        folder = at.split("/")[:-1]
        if not m.startswith(("./", "../")):
            dots = len(m) - len(m.lstrip("."))
            m = "../" * (dots - 1) + m[dots:].replace(".", "/")
        for s in m.split("/"):
            if s == "..":
                if not folder:
                    return None
                folder.pop()
            elif s not in ("", "."):
                folder.append(s)
        return probe("/".join(folder))

    got = answers(spark, asked)
    assert {k: v[0] for k, v in got.items()} == {k: want(*k) for k in asked}
    assert got["k.ts", "./a/c"] == ("a/c/index.tsx", "relative") and got["k.ts", "./src/x"][0] == "src/x.ts"


def test_the_longest_prefix_wins_whatever_the_order(spark):
    aliases = [("@", "nowhere", False), ("@/src", "src", False), ("@/src/deep", "a", False), ("one", "root.ts", True), ("~", "@/src", False), ("r", "s", False), ("s", "r", False)]
    for given in (aliases, aliases[::-1]):
        got = answers(spark, [("k.ts", m) for m in ("@/src/x", "@/src/deep/b", "@/srcx", "@", "one", "one/two", "~/deep/y", "~/x.js", "r/x", "react", None)], given)
        assert {m: f for (_, m), (f, _) in got.items()} == {
            "@/src/x": "src/x.ts", "@/src/deep/b": "a/b.py", "@/srcx": None, "@": None, "one": "root.ts", "one/two": None, "~/deep/y": None, "~/x.js": "src/x.ts", "r/x": None, "react": None, None: None,
        }


def test_module_paths_are_for_go_alone(spark):
    got = answers(spark, [("cmd/m.go", "ex.com/p/pkg"), ("cmd/m.go", "ex.com/p/only"), ("cmd/m.go", "ex.com/px/pkg"), ("cmd/m.go", "ex.com/p"), ("k.ts", "ex.com/p/pkg")], modules=["ex.com/p"])
    assert got["cmd/m.go", "ex.com/p/pkg"] == ("pkg/z.go", "module") and got["cmd/m.go", "ex.com/p/only"] == ("only/t_test.go", "module")
    assert [got[k][0] for k in (("cmd/m.go", "ex.com/px/pkg"), ("cmd/m.go", "ex.com/p"), ("k.ts", "ex.com/p/pkg"))] == [None] * 3


def test_configuration_files(spark):
    text = json.dumps({"compilerOptions": {"baseUrl": "./web", "paths": {"@/*": ["./src/*"], "x": ["y.ts"], "bad/*": ["z"], "none": []}}}, indent=1)
    rows = [("p", "tsconfig.json", "// said\n" + text + "\n/* end */"), ("p", "tsconfig.base.json", '{"compilerOptions": {"paths": {"@/*": ["other/*"], "k/*": ["l/*"]}}}'), ("q", "tsconfig.json", "{"), ("q", "tsconfig.app.json", None)]
    f = spark.createDataFrame(rows, "project string, path string, text string")
    assert sorted(map(tuple, A.configured(f).collect())) == [("p", "@", "web/src", False), ("p", "k", "l", False), ("p", "x", "web/y.ts", True)]
    g = spark.createDataFrame([("p", "go.mod", "// x\nmodule a.b/c\n"), ("q", "go.mod", ""), ("r", "x/go.mod", "module z")], "project string, path string, text string")
    assert list(map(tuple, A.go_modules(g).collect())) == [("p", "a.b/c")]


@pytest.mark.parametrize("path,want", [("a/./b//c", "a/b/c"), ("a/../../b", "../b"), ("../..", "../.."), ("", ""), ("a/b/..", "a")])
def test_folding(spark, path, want):
    assert spark.range(1).select(A.folded(F.lit(path))).first()[0] == want
