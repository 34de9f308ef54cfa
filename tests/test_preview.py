"""Keyword search, previews of edits, change requests and answers of interfaces on small tables with known results."""

from pyspark.sql import functions as F

from tessera.operators import keyword as K
from tessera.operators import preview as P
from tessera.operators import requests as Q
from tessera.operators import resolution as R
from tessera.operators import search as S
from tessera.sources import code

SYMBOLS = "id string, project string, path string, kind string, name string, summary string, content string, refs int, exported boolean, start_line int, end_line int"
ROWS = [
    ("a", "p", "src/auth.py", "function", "login", "Signs a user in", "def login(): pass", 3, True, 1, 2),
    ("b", "p", "src/user.py", "class", "UserStore", "Keeps users", "class UserStore: pass  # TODO: login later", 40, False, 1, 9),
    ("c", "p", "tests/test_auth.py", "function", "test_logon", "", 'x = "login here"', 0, False, 5, 6),
    ("d", "q", "src/other.py", "method", "Other.run", None, None, 0, False, 1, 1),
    ("e", "q", "src/far.py", "function", "main", "", "a = 1\nlogin()\n", 0, True, 10, 12),
]


def symbols(spark):
    return spark.createDataFrame(ROWS, SYMBOLS)


def test_queries_are_expanded():
    said, more = K.expand_query("loginUser")
    assert said == {"loginuser", "login", "user"} and {"auth", "signin", "account", "member"} <= more and "login" not in more
    assert K.words_of("getHTMLPage x_y of") == ["get", "html", "page", "of"]


def test_keyword_scores(spark):
    got = {r["id"]: (r["score"], r["match"]) for r in K.keyword_search(symbols(spark), "login").collect()}
    # equal name 20, name 10, edit similarity 15, content 1, kind 10, callers 1.5, exported 3
    assert got["a"] == (60.5, "name, fuzzy, content")
    assert got["b"] == (1 + 8 + 10.0, "content")
    assert got["c"][0] == round(5 + 1 + 10 - 5, 1) and "synonym" in got["c"][1]
    assert "d" not in got
    boosted = {r["id"]: r["score"] for r in K.keyword_search(symbols(spark), "login", boost=("src/user.py",)).collect()}
    assert boosted["b"] == got["b"][0] + 8
    hits = spark.createDataFrame([("b", 4.0), ("a", 2.0)], "id string, score double")
    ranked = {r["id"]: r["score"] for r in K.keyword_search(symbols(spark), "login", hits).collect()}
    assert ranked["b"] == 30 + 18.0 and ranked["a"] == 15 + 59.5 and set(ranked) == {"a", "b", "c"}
    assert [r["id"] for r in K.keyword_search(symbols(spark), "login", kind="class").collect()] == ["b"]
    assert [r["id"] for r in K.keyword_search(symbols(spark), "login", project="Q").collect()] == ["e"]


def test_stored_postings_answer_like_the_scan(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    K.save_postings(docs, "doc_id", "text", str(tmp_path / "i"))
    for q in (["the", "hand", "eau", "the"], ["para"], ["nosuchword"], []):
        want = [tuple(r) for r in S.bm25(docs, "doc_id", "text", q).collect()]
        got = [tuple(r) for r in K.search_postings(spark, str(tmp_path / "i"), "doc_id", q).collect()]
        assert [k for k, _ in got] == [k for k, _ in want] and all(abs(a - b) < 1e-5 for (_, a), (_, b) in zip(got, want))
    plan = K.search_postings(spark, str(tmp_path / "i"), "doc_id", ["hand"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_text_search(spark):
    got = {(r["id"], r["type"], r["text"]) for r in K.text_search(symbols(spark), "LOGIN").collect()}
    assert got == {("a", "content", "def login(): pass"), ("b", "todo", "# TODO: login later"), ("b", "comment", "TODO: login later"), ("c", "string", "login here"), ("e", "content", "a = 1 login()")}
    assert {r["id"] for r in K.text_search(symbols(spark), "login", "string").collect()} == {"c"}


def test_concepts_of_three_weights(spark):
    terms = spark.createDataFrame([("s1", "f", "pay"), ("s1", "f", "card"), ("s2", "f", "cash"), ("s3", "g", "auth")], "id string, path string, term string")
    edges = spark.createDataFrame([("s1", "s3")], "source string, target string")
    callers = spark.createDataFrame([("s2", "k"), ("s3", "k"), ("s1", "lone")], "symbol_id string, caller_id string")
    got = {(r["x"], r["y"]): r["c"] for r in K.concept_pairs(terms, edges, callers).collect()}
    half = {("card", "pay"): 1.0, ("card", "cash"): 1.0, ("cash", "pay"): 1.0, ("auth", "card"): 2.0, ("auth", "pay"): 2.0, ("auth", "cash"): 1.5}
    assert got == half | {(y, x): c for (x, y), c in half.items()}


def test_references_are_scored(spark):
    refs = spark.createDataFrame([("src/a.py", "p", "high"), ("tests/test_a.py", "p", None), ("src/x/b.py", "q", "low")], "path string, project string, confidence string")
    one = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = {r["path"]: r["relevance"] for r in K.score_references(refs, "src/main.py", "p", one("src/a.py"), one("src/a.py", "src/x/b.py")).collect()}
    assert got == {"src/a.py": 10 + 8 + 3 + 5, "tests/test_a.py": 5 - 5 + 3, "src/x/b.py": 1 + 4 + 2}


def test_call_sites_and_risk(spark):
    s = symbols(spark)
    callers = spark.createDataFrame([("a", "e"), ("a", "e"), ("a", "b"), ("d", "d")], "symbol_id string, caller_id string")
    targets = spark.createDataFrame([("a",), ("d",)], "id string")
    sites = P.call_sites(callers, s, s, targets)
    assert sorted((r["target"], r["caller"], r["line"], r["code"]) for r in sites.collect()) == [("a", "b", 1, "class UserStore: pass  # TODO: login later"), ("a", "e", 11, "login()")]
    risk = lambda change: {r["target"]: r["risk"] for r in P.edit_risk(sites, targets, change).collect()}
    assert risk("modify") == {"a": "moderate", "d": "safe"} and risk("delete") == {"a": "moderate", "d": "safe"}
    assert [r["id"] for r in P.find_symbol(s, "run").collect()] == ["d"] and [r["id"] for r in P.find_symbol(s, "a").collect()] == ["a"] and P.find_symbol(s, "zzz").count() == 0


def test_paths_from_entries(spark):
    s = spark.createDataFrame([(i, "function", n, False, 1) for i, n in [("t", "work"), ("u", "middle"), ("m", "main"), ("r", "root"), ("z", "beyond")]], "id string, kind string, name string, exported boolean, refs int")
    callers = spark.createDataFrame([("t", "u"), ("u", "m"), ("m", "z"), ("t", "r")], "symbol_id string, caller_id string")
    got = {(tuple(r["path"]), r["entry"]) for r in P.trace_up(callers, s, spark.createDataFrame([("t",)], "id string")).collect()}
    assert got == {(("m", "u", "t"), True), (("r", "t"), False)}


def test_files_as_text(spark):
    rows = code.parse("p", "a.py", '"""Doc."""\nimport os\nclass K:\n    """Kay."""\n    def f(self):\n        pass\n')
    d = spark.createDataFrame(rows, code.SCHEMA)
    info = P.file_infos(code.symbols(d), code.edges(d))
    assert [(r["symbols"], r["kinds"], r["imports"]) for r in info.collect()] == [(2, ["class", "method"], ["os"])]
    text = P.file_texts(info).first()["text"]
    assert text.startswith("# File: a.py") and "Kay." in text and "- os" in text and "- `method` **K.f** (L5)" in text
    p = P.project_texts(info).first()
    assert p["files"] == 1 and "`a.py`" in p["text"] and p["tokens"] == len(p["text"]) // 4
    paths = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "id string, path string")
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "symbol_id string, caller_id string")
    assert sorted(map(tuple, P.related_files(links, paths).collect())) == [("x", "y", 2), ("y", "x", 2)]


DIFF = """diff --git a/src/api/user.py b/src/api/user.py
--- a/src/api/user.py
+++ b/src/api/user.py
@@ -1,2 +1,2 @@
-def load(a, b):
+def load(a):
-def gone(x):
 same
diff --git a/web/x.ts b/web/x.ts
--- a/web/x.ts
+++ b/web/x.ts
@@ -1 +1 @@
-export const old = 1
+let fresh = 2
diff --git a/config/settings.yaml b/config/settings.yaml
--- a/config/settings.yaml
+++ /dev/null
@@ -1 +0,0 @@
-password: token
"""


def test_change_requests(spark):
    d = spark.createDataFrame([(1, DIFF), (2, ""), (3, None), (4, "diff --git a/r.md b/r.md\n--- a/r.md\n+++ b/r.md\n@@ -1 +1 @@\n+hi\n")], "id int, text string")
    files = Q.changed_files(d)
    assert sorted((r["id"], r["file"], len(r["added"]), len(r["deleted"])) for r in files.collect()) == [(1, "config/settings.yaml", 0, 1), (1, "src/api/user.py", 1, 2), (1, "web/x.ts", 1, 1), (4, "r.md", 1, 0)]
    assert sorted(tuple(r) for r in Q.breaking(files).collect()) == [(1, "src/api/user.py", "gone", "deletion"), (1, "src/api/user.py", "load", "signature_change"), (1, "web/x.ts", "old", "export_removed")]
    got = {r["id"]: r for r in Q.risk(d).collect()}
    assert set(got) == {1, 4} and (got[4]["score"], got[4]["level"]) == (0, "low")
    assert got[1]["touches"] == "api,auth,config,breaking" and got[1]["score"] == 15 + 20 + 10 + 20 and got[1]["level"] == "high"
    s = spark.createDataFrame([("u", "src/api/user.py"), ("v", "src/b.py"), ("w", "web/x.ts")], "id string, path string")
    callers = spark.createDataFrame([("u", "v"), ("u", "w")], "symbol_id string, caller_id string")
    assert [tuple(r) for r in Q.reached(files, s, callers).collect()] == [(1, "v", "src/b.py")]
    paths = spark.createDataFrame([("tests/test_user.py",), ("x/web/x.spec.ts",), ("other.py",)], "path string")
    assert sorted(tuple(r) for r in Q.suggested_tests(files, paths).collect()) == [(1, "tests/test_user.py"), (1, "x/web/x.spec.ts")]


def test_clusters_and_noise(spark):
    d = spark.createDataFrame([(["api/x.py", "models/y.py"],), (["a.vue", "test_a.py"],), (["i18n/de.json"],), (["x.py"],)], "f array<string>")
    assert [r[0] for r in d.select(Q.category(F.col("f"))).collect()] == ["api_endpoint", "component_with_test", "i18n_bundle", "coupled_files"]
    n = spark.createDataFrame([("a/yarn.lock",), (".env",), ("dist/x.js",), ("src/x.js",)], "p string")
    assert [r[0] for r in n.select(Q.is_noise(F.col("p"))).collect()] == [True, True, True, False]


def test_answers_of_interfaces(spark):
    text = 'return {"success": True}\n# return {"x": 1}\nreturn JSONResponse({"data": 1})\nreturn {"ok": True, "data": 1}\nx = {}\n'
    d = spark.createDataFrame([("app/api/a.py", text), ("app/api/b.ts", "return { error: e }\nres.json({ ok: true })"), ("app/x.py", text), ("tests/api/c.py", text)], "path string, text string")
    got = Q.answers(d)
    assert sorted((r["path"], r["line"], r["issue"]) for r in got.collect() if r["issue"]) == [("app/api/a.py", 1, "wrong_key"), ("app/api/a.py", 3, "missing_ok"), ("app/api/a.py", 3, "missing_ok"), ("app/api/b.ts", 1, "missing_ok")]
    assert [tuple(r) for r in Q.compliance(got).collect()] == [(6, 4, (6 - 4) / 6 * 100)]


def test_resolution_of_methods_and_stages(spark):
    s = spark.createDataFrame(
        [("p", "a.py:function:go", "a.py", "function", "go", 1), ("p", "b.py:method:K.do", "b.py", "method", "K.do", 2), ("p", "c.py:function:same", "c.py", "function", "same", 1), ("p", "d.py:function:same", "d.py", "function", "same", 1)],
        "project string, id string, path string, kind string, name string, start_line int",
    )
    e = spark.createDataFrame(
        [("p", "x.py:file:x", "a", "imports", 1, ["go"]), ("p", "x.py:file:x", "b", "imports", 2, ["obj"]), ("p", "x.py:function:f", "go", "calls", 3, []), ("p", "x.py:function:f", "obj.do", "calls", 4, []), ("p", "x.py:function:f", "same", "calls", 5, []), ("p", "x.py:function:f", "len", "calls", 6, [])],
        "project string, source string, target string, type string, line int, names array<string>",
    )
    got = {r["target"]: (r["found"], r["stage"]) for r in R.resolved(s, e).collect()}
    assert got == {"go": ("a.py:function:go", "import"), "obj.do": ("b.py:method:K.do", "method"), "same": (None, None), "len": (None, None)}


def test_what_changed_is_resolved_anew(spark):
    """Random projects: resolving only the changed files again gives what resolving everything gives."""
    import random

    for seed in (7,):
        rng = random.Random(seed)
        names = [f"name{k}" for k in range(6)]

        def project(changed=()):
            files = {}
            for k in range(5):
                r = random.Random(f"{seed}-{k}-{'new' if k in changed else 'old'}")
                own = names[k]
                calls = "".join(f"    {r.choice(names)}(1)\n" for _ in range(3))
                files[f"f{k}.py"] = f"from f{r.randrange(5)} import {r.choice(names)}\n\n\ndef {own}(x):\n{calls}    return x\n"
            return files

        def scanned(files):
            rows = [r for p, t in files.items() for r in code.parse("p", p, t)]
            d = spark.createDataFrame(rows, code.SCHEMA)
            return code.symbols(d), code.edges(d)

        changed = rng.sample(range(5), 2)
        before = R.resolved(*scanned(project()))
        s, e = scanned(project(changed))
        paths = spark.createDataFrame([("p", f"f{k}.py") for k in changed], "project string, path string")
        key = lambda df: sorted(map(str, df.collect()))
        assert key(R.refreshed(before, s, e, paths)) == key(R.resolved(s, e))


def test_equal_ids_of_two_projects_are_two(spark):
    rows = [("a", p, f"src/a{p}.py", "function", "login", "", "login", 0, False, 1, 2) for p in ("p", "q")] + [("b", "q", "src/b.py", "function", "other", "", "x\nlogin()", 0, False, 4, 5)]
    s = spark.createDataFrame(rows, SYMBOLS)
    assert [(r["id"], r["project"]) for r in K.keyword_search(s, "login").collect() if r["id"] == "a"] == [("a", "p"), ("a", "q")]
    hits = spark.createDataFrame([("q", "a", 2.0), ("p", "a", 1.0)], "project string, id string, score double")
    got = {(r["id"], r["project"]): r["score"] for r in K.keyword_search(s, "login", hits).collect()}
    assert got["a", "q"] - got["a", "p"] == 15
    callers = spark.createDataFrame([("q", "a", "b")], "project string, symbol_id string, caller_id string")
    targets = spark.createDataFrame([("p", "a"), ("q", "a")], "project string, id string")
    sites = P.call_sites(callers, s, s, targets)
    assert [(r["project"], r["target"], r["line"]) for r in sites.collect()] == [("q", "a", 5)]
    assert {(r["project"], r["sites"]) for r in P.edit_risk(sites, targets, "delete").collect()} == {("p", 0), ("q", 1)}
    assert sorted(map(tuple, P.related_files(callers, s).collect())) == [("q", "src/aq.py", "src/b.py", 1), ("q", "src/b.py", "src/aq.py", 1)]
    changed = spark.createDataFrame([(1, "p", "src/ap.py"), (2, "q", "src/aq.py")], "id int, project string, file string")
    assert [tuple(r) for r in Q.reached(changed, s, callers).collect()] == [(2, "q", "b", "src/b.py")]
    terms = spark.createDataFrame([("p", "1", "f", "x"), ("q", "1", "f", "y"), ("p", "2", "f", "z")], "project string, id string, path string, term string")
    none = spark.createDataFrame([], "project string, source string, target string")
    pairs = K.concept_pairs(terms, none, none.toDF("project", "symbol_id", "caller_id"))
    assert {(r["x"], r["y"]) for r in pairs.collect()} == {("x", "z"), ("z", "x")}


def test_project_texts_name_the_first_files(spark):
    rows = [("p", f"f{k:02}.py", f"s{k}") for k in range(30)] + [("q", "a.py", None)]
    got = {r["project"]: r for r in P.project_texts(spark.createDataFrame(rows, "project string, path string, summary string"), 3).collect()}
    assert got["p"]["files"] == 30 and [x[:12] for x in got["p"]["text"].split("\n")[3:]] == ["- `f00.py`: ", "- `f01.py`: ", "- `f02.py`: "] and "`a.py`: " in got["q"]["text"]


def test_text_search_of_documents_with_comments_and_strings(spark, tmp_path):
    """What stands in a comment, a marker or a string is in the document too: the query and its twin name the same ones."""
    from tessera.plans import registry
    from tests.oracle import agree

    texts = ["# mending the roof", "it's mending the roof's edge", "// TODO: mending the roof", '"Mending the roof"', "/* mending the */ mending the", "mending the roof", "mending a roof", None]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/own")
    for t in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    (tmp_path / "documents.parquet").symlink_to(next((tmp_path / "own").glob("*.parquet")))
    agree(spark, registry.QUERIES["text_search"], registry.ORACLES["text_search"], str(tmp_path))
