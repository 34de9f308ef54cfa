import json
import sqlite3
import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.operators import project as J
from tessera.operators import rules as U
from tessera.operators import security as S
from tessera.sources import catalog, code, histories, manifests, schemas


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# ---------------------------------------------------------------- histories


def test_logs(spark):
    t = spark.createDataFrame([("COMMIT:a|12|me|fix: x|y\n1\t2\tp/q.py\n-\t-\tb.png\n\nCOMMIT:b|zz|me|m\n\nCOMMIT:bad\nfoo\n",), (None,), ("",)], "t string")
    assert rows(histories.log_numstat(t, "t"), "commit", "ts", "message", "path", "insertions", "deletions") == [("a", 12, "fix: x|y", "b.png", 0, 0), ("a", 12, "fix: x|y", "p/q.py", 1, 2)]
    assert rows(histories.log(t, "t"), "commit", "ts") == [("a", 12), ("b", 0)]
    names = spark.createDataFrame([("COMMIT:a|1|x|s\r\n\r\nf.py\r\ng h.py\r\n",)], "t string")
    assert rows(histories.log_files(names, "t"), "path") == [("f.py",), ("g h.py",)]


def test_diffs(spark):
    t = spark.createDataFrame([("+++ b/x.py\n@@ -1 +1,3 @@ def\n+a\n@@ -9,2 +12,0 @@\n@@ -1 +20 @@\n--- a/z\n+++ /dev/null\n@@ -1 +1 @@\n",), (None,), ("@@ -1 +1 @@",)], "t string")
    assert rows(histories.diff_ranges(t, "t"), "path", "start", "end") == [("x.py", 1, 3), ("x.py", 20, 20)]
    assert rows(histories.diff_lines(t, "t"), "line") == [(1,), (2,), (20,), (3,)]


def test_coverage(spark, tmp_path):
    n = spark.createDataFrame([(1, bytearray(b"\xff\x00\xff")), (2, bytearray(b"")), (3, None)], "k int, b binary")
    assert [r[1] for r in sorted(rows(histories.numbits(n, "b", "k"), "k", "line"))] == [*range(1, 9), *range(17, 25)]
    x = spark.createDataFrame([('<class filename="a.py"><lines><line number="1" hits="2"/><line number="2" hits="0"/></lines></class><class filename="b.py"><line hits="1" number="7"/></class>',), (None,)], "t string")
    assert rows(histories.coverage_xml(x, "t"), "path", "line") == [("a.py", 1), ("b.py", 7)]
    j = spark.createDataFrame([('{"files":{"a.py":{"executed_lines":[1,2]},"b.py":{"executed_lines":[]}}}',), ("{bad",)], "t string")
    assert rows(histories.coverage_json(j, "t"), "path", "line") == [("a.py", 1), ("a.py", 2)]
    con = sqlite3.connect(":memory:")
    con.executescript("create table file(id int, path text); create table line_bits(file_id int, context_id int, numbits blob); insert into file values (1, 'q.py')")
    con.executemany("insert into line_bits values (1, ?, ?)", [(0, b"\x05"), (1, b"\x03")])
    con.commit()
    f = spark.createDataFrame([("f", bytearray(con.serialize())), ("g", bytearray(b"junk")), ("h", None)], "path string, content binary")
    assert rows(histories.coverage_sqlite(f), "report", "path", "line") == [("f", "q.py", 1), ("f", "q.py", 2), ("f", "q.py", 3)]


# ---------------------------------------------------------------- manifests

FILES = [
    ("package.json", '{"dependencies":{"@a/b":"^1.2","x":{}},"devDependencies":{"jest":"29"}}', ["declared npm @a/b ^1.2 production", "declared npm jest 29 dev"]),
    ("package-lock.json", '{"packages":{"":{},"node_modules/@a/b":{"version":"1.2.3"}}}', ["pinned npm @a/b 1.2.3 "]),
    ("package-lock.json", '{"dependencies":{"l":{"version":"1"}}}', ["pinned npm l 1 "]),
    ("requirements-dev.txt", "# c\nflask==1.0\n-r x\nrequests[socks] >= 2 ; python\n", ["declared pypi flask ==1.0 dev", "declared pypi requests[socks] >=2 dev"]),
    ("pyproject.toml", '[project]\ndependencies=["a>=1"]\n[project.optional-dependencies]\ntest=["pytest"]\n[tool.poetry.dependencies]\npython="3"\nq={version="2"}\n', ["declared pypi a >=1 production", "declared pypi pytest  dev", "declared pypi q 2 production"]),
    ("go.mod", "require (\n a/b v1.0\n c/d v2.0 // indirect\n)\nrequire e/f v3\n", ["declared go a/b v1.0 production", "declared go c/d v2.0 indirect", "declared go e/f v3 production", "pinned go a/b v1.0 ", "pinned go c/d v2.0 ", "pinned go e/f v3 "]),
    ("yarn.lock", '"react@^18", preact@18:\n  version "18.2.0"\n', ["pinned npm preact 18.2.0 ", "pinned npm react 18.2.0 "]),
    ("pnpm-lock.yaml", "  /@s/p@1.2.3:\n  /lodash@4.17.21:\n", ["pinned npm @s/p 1.2.3 ", "pinned npm lodash 4.17.21 "]),
    ("Cargo.toml", '[dependencies]\nserde="1"\n[target.x.dev-dependencies]\nt={version="3"}\n', ["declared cargo serde 1 production", "declared cargo t 3 dev"]),
    ("Cargo.lock", '[[package]]\nname="serde"\nversion="1.0.1"\n[metadata]\nname="no"\n', ["pinned cargo serde 1.0.1 "]),
    ("pom.xml", '<p xmlns="u"><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version><scope>test</scope></dependency></p>', ["declared maven g:a 1 dev"]),
    ("build.gradle.kts", "implementation 'g:a:1'\ntestImplementation(\"j:u:2\")\nkapt 'solo'", ["declared maven g:a 1 production", "declared maven j:u 2 dev", "declared maven solo  build"]),
    ("Gemfile", "gem 'rails', '~> 7'\ngroup :test do\n gem 'rspec'\nend\n", ["declared gem rails ~> 7 production", "declared gem rspec  dev"]),
    ("Gemfile.lock", "GEM\n  specs:\n    rails (7.0.1)\n      x (1)\n", ["pinned gem rails 7.0.1 "]),
    ("x/Dockerfile.dev", "FROM python:3.12 AS b\nFROM ${X}\nFROM scratch\nFROM r.io:80/x\n", ["declared docker python 3.12 production", "declared docker r.io:80/x latest production", "pinned docker python 3.12 ", "pinned docker r.io:80/x latest "]),
    ("composer.json", '{"require":{"php":"8","ext-x":"1","a/b":"1"}}', ["declared composer a/b 1 production"]),
    ("composer.lock", '{"packages":[{"name":"a/b","version":"v1.2"}]}', ["pinned composer a/b 1.2 "]),
    ("pubspec.yaml", "name: x\ndependencies:\n  http: ^0.13\n  flutter:\ndev_dependencies:\n  l: '1'\n", ["declared pub http 0.13 production", "declared pub l 1 dev"]),
    ("pubspec.lock", 'packages:\n  http:\n    dependency: x\n    version: "0.13.5"\n', ["pinned pub http 0.13.5 "]),
    ("Package.resolved", '{"object":{"pins":[{"package":"i","state":{"version":"1"}}]}}', ["declared swift i 1 production", "pinned swift i 1 "]),
    ("a.csproj", '<PackageReference Include="N" Version="1"/>', ["declared nuget N 1 production"]),
    ("packages.lock.json", '{"dependencies":{"net":{"N":{"resolved":"1.0"}}}}', ["pinned nuget N 1.0 "]),
    ("mix.exs", '{:p, "~> 1.2", only: :test}', ["declared hex p ~> 1.2 dev"]),
    ("mix.lock", '"p": {:hex, :p, "1.2.3"', ["pinned hex p 1.2.3 "]),
    ("Pipfile", '[packages]\na="*"\nb={git="x"}\n', ["declared pypi a * production", "declared pypi b * production"]),
    ("poetry.lock", '[[package]]\nname="Q"\nversion="2.1"\n', ["pinned pypi q 2.1 "]),
    ("package.json", "{bad", []), ("package.json", "[1]", []), ("pom.xml", "<a", []), ("other.txt", "a==1", []), ("go.mod", "", []),
]


@pytest.mark.parametrize("path,text,want", FILES)
def test_manifest(path, text, want):
    assert sorted(" ".join(r) for r in manifests.parse(path, text)) == want


def test_inventory(spark):
    f = spark.createDataFrame([("p", "package.json", FILES[0][1]), ("p", "package-lock.json", FILES[1][1]), ("p", "n", None), ("p", None, "x")], "project string, path string, text string")
    inv = manifests.inventory(manifests.packages(f).withColumn("project", F.lit("p")), "project")
    assert rows(inv, "name", "pinned") == [("@a/b", "1.2.3"), ("jest", None)]
    doc = json.loads(manifests.sbom(inv, "project").first()["sbom"])
    assert [c["purl"] for c in doc["components"]] == ["pkg:npm/%40a/b@1.2.3", "pkg:npm/jest@29"] and doc["dependencies"][0]["dependsOn"] == ["pkg:npm/%40a/b@1.2.3", "pkg:npm/jest@29"]
    assert manifests.conflicts(inv, "project").count() == 0
    used = spark.createDataFrame([("p", "Next", "^14"), ("p", "github.com/gofiber/fiber/v2", "v2.1"), ("p", "jest", "29")], "project string, name string, version string")
    seen = J.frameworks(used, spark.createDataFrame([("p", "a/manage.py"), ("p", None)], "project string, path string"), "project")
    assert set(rows(seen, "framework", "kind", "version")) == {("django", "api", None), ("fiber", "api", "v2.1"), ("nextjs", "ssr", "^14")}


# ---------------------------------------------------------------- code


def found(path, text, row):
    return {f"{r['kind']} {r['name']}" for r in code.parse("p", path, text) if r["row"] == row}


def test_python():
    text = "from x import y\nclass A(B):\n    '''doc'''\n    f: int\n    def g(self, a: int) -> str:\n        return h(a.b())\n@app.route('/x', methods=['GET','post'])\nasync def top(q):\n    def inner(): z()\nrun()\n"
    assert found("m.py", text, "symbol") == {"class A", "method A.g", "function top", "api GET,POST /x"}
    calls = {(r["source"], r["name"]) for r in code.parse("p", "m.py", text) if r["kind"] == "calls"}
    assert ("m.py:method:A.g", "a.b") in calls and ("m.py:function:top", "z") in calls and ("m.py:file:m", "run") in calls
    assert code.parse("p", "m.py", "def (") == [] and code.parse("p", "m.py", "\0") == [] and code.parse("p", "m.py", "") == []
    assert "re_exports s" in found("__init__.py", "from .s import n", "edge")


def test_typescript():
    text = "import d, {x as y} from './m' // import q from 'z'\nexport {k} from './k'\nexport function useA(a: number): string {\n  fetch(`/api/u/${a}?x=1`)\n  return foo.bar(a)\n}\nclass Q extends R implements S, T { m() { 'if (x) {' } }\napp.get('/h', handler)\n"
    assert found("a.ts", text, "symbol") == {"composable useA", "class Q", "api GET /h"}
    assert {"imports ./m", "re_exports ./k", "extends R", "implements S", "implements T", "api_calls GET /api/u/*", "calls foo.bar"} <= found("a.ts", text, "edge")
    assert "imports z" not in found("a.ts", text, "edge")
    assert "component Card" in found("c.tsx", "export function Card(p) { return 1 }", "symbol")
    assert "api GET /cats/:id" in found("n.ts", "@Controller('cats')\nexport class C {\n @Get(':id')\n one() {}\n}\n", "symbol")
    vue = "<template><div><my-card/><Foo/></div></template>\n<script setup lang='ts'>\nconst p = defineProps<{title: string}>()\nuseStore()\n</script>\n"
    assert "component v" in found("v.vue", vue, "symbol") and {"uses MyCard", "uses Foo", "uses useStore"} <= found("v.vue", vue, "edge")


def test_go_java_rust():
    go = 'package m\nimport (\n "fmt"\n s "a/str"\n)\ntype I interface {\n Foo(x int) error\n}\ntype B struct {\n Base\n X int\n}\nfunc (b *B) Foo(x int) error {\n fmt.Println("a{")\n return nil\n}\nconst K = 1\nfunc r() { mux.HandleFunc("GET /q", h) }\n'
    assert found("g.go", go, "symbol") == {"interface I", "class B", "method B.Foo", "variable K", "function r", "api GET /q"}
    assert {"imports fmt", "imports a/str", "extends Base", "implements I", "calls fmt.Println"} <= found("g.go", go, "edge")
    java = "import java.util.List;\npublic class Foo<T> extends Bar implements Baz<T>, Qux {\n  public Foo(int a) { init(); }\n  public List<String> get(Map<K,V> m, int b) throws E {\n    return new Zed();\n  }\n  enum Color { RED }\n}\n"
    assert found("J.java", java, "symbol") == {"class Foo", "method Foo.Foo", "method Foo.get", "type Color"}
    assert {"imports java.util.List", "extends Bar", "implements Baz", "implements Qux", "calls init"} <= found("J.java", java, "edge")
    rust = "use std::{io, fs::{self, File as F}};\npub struct P { a: i32 }\npub trait T { fn d(&self); }\nimpl T for P {\n  pub fn go<'a>(&self, n: &'a str) -> i32 { helper('{') }\n}\nfn main() {}\nenum E { A }\n"
    assert found("r.rs", rust, "symbol") == {"class P", "interface T", "method P.go", "function main", "type E"}
    assert {"imports std::io", "imports std::fs::self", "imports std::fs::File", "implements T", "calls helper"} <= found("r.rs", rust, "edge")


def test_blank_keeps_offsets():
    for language, text in [("typescript", "a /* { */ '}' `x${1}` // }\nb"), ("go", 'a `{\n` "\\"{" \'{\''), ("rust", 'r#"{"# \'a \'{\' "{"'), ("java", '"""\n{""" \'{\'')]:
        out = code.blank(text, language)
        assert len(out) == len(text) and out.count("\n") == text.count("\n") and "{" not in out and "}" not in out


def test_scan(spark):
    f = spark.createDataFrame([("p", "a.py", "f()\nf()\n"), ("p", "b.txt", "x"), ("p", None, "x"), ("p", "c.go", None)], "project string, path string, text string")
    out = code.scan(f)
    assert rows(code.edges(out), "source", "target", "line") == [("a.py:file:a", "f", 2)] and code.symbols(out).count() == 0
    assert code.scan(f.limit(0)).count() == 0


# ---------------------------------------------------------------- schemas


@pytest.mark.parametrize(
    "spelled,language,want",
    [
        ("Optional[int]", "python", "number | null"), ("list[str]", "python", "string[]"), ("dict[str, int]", "python", "Record<string, number>"), ("X | None", "python", "X | null"), ("Union[int, str, None]", "python", "number | string | null"),
        ("tuple[int, ...]", "python", "number[]"), ("tuple[int, str]", "python", "array"), ("Annotated[list[int], 3]", "python", "number[]"), ("Literal['a', 'b']", "python", "'a' | 'b'"), ("Callable[[int], str]", "python", "function"),
        ("string[]", "typescript", "string[]"), ("Record<string, number[]>", "typescript", "Record<string, number[]>"), ("Array<string | null>", "typescript", "string | null[]"), ("", "python", "any"), ("undefined", "typescript", "null"),
    ],
)
def test_canonical(spelled, language, want):
    assert schemas.canonical(spelled, language) == want


def test_models(spark):
    py = "class B(BaseModel):\n    a: int\nclass M(B):\n    b: Optional[str] = Field(None, alias='bee')\nclass E(BaseModel): pass\n"
    ts = "interface M extends N { a: string; bee?: string }\ninterface N {\n  f: (x: number) => void,\n}\ntype O = Omit<M, 'a'>\ntype P = Partial<M>\n"
    f = spark.createDataFrame([("x", "m.py", py), ("y", "m.ts", ts), ("z", "n.py", None), ("z", "bad.py", "class")], "project string, path string, text string")
    m = schemas.models(f)
    full = schemas.inherited(m)
    assert rows(full.where("project = 'x'"), "model", "field", "type", "optional") == [("B", "a", "number", False), ("M", "a", "number", False), ("M", "bee", "string | null", True)]
    assert rows(full.where("project = 'y' and model in ('O', 'P')"), "model", "field", "optional") == [("O", "bee", True), ("P", "a", True), ("P", "bee", True)]
    assert rows(schemas.drift(full.where("model = 'M'")), "field", "issue") == [("a", "type_mismatch"), ("bee", "type_mismatch"), ("f", "missing_in_producer")]


# ---------------------------------------------------------------- security, rules, projects

VULNERABLE = """
def view():
    q = request.args.get("q")
    cursor.execute("select " + q)
    n = int(request.args["n"])
    cursor.execute("x %s" % n)
    cursor.execute("x", (q,))
    os.system(shlex.quote(q))
    for x in request.form: eval(x)
    helper(q)
    q = "a"
    os.system(q)
    subprocess.run(input(), shell=True)
def helper(v):
    deep(f"z{v}")
def deep(w):
    os.system(w)
class K:
    def m(self, p): pickle.loads(p)
def use():
    K().m(sys.argv[1])
"""


def test_taint(spark):
    f = spark.createDataFrame([("a.py", VULNERABLE), ("b.py", None), ("c.py", "def"), ("d.go", "x")], "path string, text string")
    flows = S.flows(f)
    assert rows(S.taint(flows), "line", "category", "severity", "hops") == [
        (10, "rce", "critical", 2), (13, "rce", "critical", 0), (21, "deserialization", "critical", 1), (4, "sql_injection", "critical", 0), (9, "rce", "critical", 0)
    ]
    assert rows(flows.where("row = 'sanitized'"), "line") == [(8,)]
    assert S.taint(flows, hops=1).where("line = 10").count() == 0


def test_line_rules(spark):
    f = spark.createDataFrame([("b.js", "db.query(req.body.x)\nres.redirect(req.query.u)\n"), ("c.py", "api_key = 'abcdefghijklmnopqrstuvwxyz0123456789'\npassword = 'your-password'\nh = hashlib.md5(x)\n"), ("n.py", None)], "path string, text string")
    out = S.line_findings(f)
    assert {("c.py", 1, "API Key", "api_key = 'abcd****'"), ("c.py", 3, "WEAK_HASH_MD5", "h = hashlib.md5(x)")} <= set(rows(out, "path", "line", "rule", "code"))
    assert out.where("rule = 'Password'").count() == 0
    assert rows(S.line_flows(f), "line", "category") == [(1, "sql_injection"), (2, "open_redirect")]


def test_infrastructure():
    rules = lambda path, text: {(a, r) for a, r, _ in S.infrastructure_issues(path, text)}
    docker = "FROM python\nADD a b\nRUN apt-get install -y x \\\n  && curl x | sh\nENV TOKEN=abc P=$Q\nEXPOSE 22 80\n"
    assert rules("Dockerfile", docker) == {(1, "FROM_LATEST"), (1, "NO_USER"), (2, "ADD_INSTEAD_OF_COPY"), (3, "APT_NO_RECOMMENDS"), (3, "PIPE_TO_SHELL"), (5, "ENV_SECRET"), (6, "EXPOSE_SENSITIVE_PORT")}
    assert rules("Dockerfile", "FROM a:1@x\nENV TOKEN=$T\nUSER a\n") == set() and rules("x.txt", docker) == set()
    assert (3, "PRIVILEGED") in rules("docker-compose.yml", "services:\n a:\n  privileged: true\n")
    tf = 'resource "aws_s3_bucket" "b" {\n acl = "public-read"\n}\nresource "aws_db_instance" "d" {\n publicly_accessible = true\n password = "hunter2x"\n}\nresource "aws_security_group" "s" {\n egress {\n  cidr_blocks = ["0.0.0.0/0"]\n }\n}\n'
    assert rules("m.tf", tf) == {(1, "IAC_TF_PUBLIC_S3"), (4, "IAC_TF_NO_ENCRYPT"), (4, "IAC_TF_PUBLIC_RDS"), (6, "IAC_TF_HARDCODED_SECRET")}
    k8s = "apiVersion: v1\nkind: Pod\nspec:\n  hostNetwork: true\n  containers:\n  - image: nginx:1\n    securityContext:\n      privileged: true\n---\nkind: x\n"
    assert rules("k.yaml", k8s) == {(2, "IAC_K8S_NO_LIMITS"), (2, "IAC_K8S_RUN_ROOT"), (4, "IAC_K8S_HOST_NETWORK"), (8, "IAC_K8S_PRIVILEGED")}


def test_rules(spark):
    f = spark.createDataFrame([("src/a/b.py", "ok\nbad(1)"), ("src/b.py", "bad(1)"), ("t.js", None)], "path string, text string")
    assert rows(U.denied_lines(f, {"r": (r"bad\(", "src/*/*.py"), "x": ("(", "**")}), "path", "line") == [("src/a/b.py", 2)]
    assert rows(U.denied_files(f, {"deep": "src/**", "flat": "*.js", "one": "**/src/?.py"}), "path", "rule") == [("src/a/b.py", "deep"), ("src/b.py", "deep"), ("src/b.py", "one"), ("t.js", "flat")]
    assert U.denied_lines(f, {"x": ("(", "**")}).count() == 0
    assert rows(U.pass_rate(U.denied_files(f, {"a": "*.js"}), 4), "broken", "rate") == [(1, 0.75)]


def test_tree_and_index(spark, tmp_path):
    root = tmp_path / "src"
    for name, data in {"a.py": b"x\ny", "d/b.py": b"z\xff", "node_modules/c.py": b"1", "e.md": b"e", "empty.py": b""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    assert rows(catalog.read_tree(spark, str(root), ["py"]), "path", "text", "lines") == [("a.py", "x\ny", 2)]
    index = tmp_path / "index.json"
    index.write_text(json.dumps({"symbols": {"s": {"name": "n", "type": "function", "path": "a.py", "start_line": 1}}, "dependencies": {"d": {"source": "s", "target": "t", "type": "calls"}}}, indent=1))
    subprocess.run(["gzip", "-k", str(index)], check=True)
    for path in (index, f"{index}.gz"):
        symbols, edges = catalog.read_index(spark, str(path))
        assert rows(symbols, "id", "start_line") == [("s", 1)] and rows(edges, "source", "target") == [("s", "t")]
    catalog.save({"symbols": symbols}, str(tmp_path / "out"))
    catalog.export({"symbols": symbols}, str(tmp_path / "json"))
    assert spark.read.parquet(str(tmp_path / "out/symbols")).count() == spark.read.json(str(tmp_path / "json/symbols")).count() == 1
    assert rows(catalog.merged(symbols.withColumn("name", F.lit("new")), symbols, "id"), "name") == [("new",)]


def test_stateful_streams(spark, tmp_path):
    from tessera.streaming import state

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    e = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "b", "2024-01-01 00:00:10"), (1, "a", "2024-01-01 00:00:20"), (2, "c", "2024-01-01 00:00:00"), (2, "d", "2024-01-03 00:00:00"), (2, None, "2024-01-03 00:00:00")], "u long, i string, t string")
    e.withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("u long, i string, t timestamp").parquet(str(tmp_path / "in"))

    def drain(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert rows(drain(state.recently_used(stream(), "u", "i", "t", "long"), "update", "mru"), "u", "items") == [(1, ["a", "b"]), (2, ["d"])]
    out = drain(state.sliding_limit(stream(), "u", "t", "long", limit=2, seconds=60), "append", "limited")
    assert rows(out.groupBy("u").agg(F.sum(F.col("refused").cast("int")).alias("n")), "u", "n") == [(1, 1), (2, 0)]


def test_function_metrics(spark):
    from tessera.sources import metrics

    py = "def f(a, *b, k=1, **c):\n    if a:\n        for x in b:\n            return 1\n    elif k:\n        pass\n    return 2\n"
    go = "package m\nfunc g(a int) int {\n\tif a > 1 {\n\t\treturn 1 // if\n\t}\n\treturn 2\n}\n"
    f = spark.createDataFrame([("p", "a.py", py), ("p", "b.go", go), ("p", "c.py", "def"), ("p", "d.py", None), ("p", "e.tsx", "")], "project string, path string, text string")
    out = metrics.scored(metrics.function_metrics(f))
    assert rows(out, "name", "lines", "depth", "params", "branches", "returns", "score") == [("f", 7, 2, 4, 4, 2, 0), ("g", 6, 2, 1, 1, 2, 0)]
    long = metrics.scored(spark.createDataFrame([("p", "a.vue", "f", 1, 110, 4, 6, 12, 0), ("p", "a.py", "f", 1, 110, 0, 0, 0, 0)], metrics.SCHEMA))
    assert rows(long, "score", "issues") == [(10, ["too long", "too deep", "too many parameters", "too many branches"]), (3, ["too long"])]


def test_declarations_of_typescript_by_grammar():
    text = """export default async function load<T extends Map<string, number>>(a: T, b = (1, 2)): Promise<Array<T>> {
}
export abstract class Box<T> extends base.Thing<T> implements One, Two<T> {
}
export const useIt: (x: number) => void = async (x) => { go(x) }
const hidden = (x) => x
export interface Shape extends A, B<C> {
}
type Id<T> = string
function* gen() {
}
@Controller('users') class C {}
@Get(':id')
app.post('/x', save)
"""
    rows = code.parse("p", "a.ts", text)
    got = sorted((r["kind"], r["name"], tuple(r["params"]), r["returns"]) for r in rows if r["row"] == "symbol")
    assert got == [
        ("api", "GET /users/:id", (), ""), ("api", "POST /x", (), ""), ("class", "Box", (), ""), ("composable", "useIt", ("x",), ""), ("function", "gen", (), ""),
        ("function", "load", ("a", "b"), "Promise<Array<T>>"), ("interface", "Shape", (), ""), ("type", "Id", (), ""),
    ]
    kin = sorted((r["kind"], r["name"]) for r in rows if r["row"] == "edge" and r["kind"] in ("extends", "implements"))
    assert kin == [("extends", "A"), ("extends", "B"), ("extends", "base.Thing"), ("implements", "One"), ("implements", "Two")]


def test_parameters_are_parted_outside_brackets():
    one = {
        "a: Map<string, List<number>>, b": ["a", "b"], "cb: (x, y) => void, z = f(1, 2)": ["cb", "z"], "{a, b: {c, d}}: P, e": ["{}", "e"],
        "[a, b]: [number, string], ...rest: T[]": ["[]", "rest"], "private readonly x: X = {a: 1, b: 2}, y?: Y": ["x", "y"], "": [], "a,": ["a"],
    }
    assert {k: code._params(k, "typescript") for k in one} == one
    assert code._params("final Map<String, List<Integer>> m, @Named(\"a, b\") int[] k, String... more", "java") == ["m", "k", "more"]
    assert code._params("&mut self, mut a: Vec<(i32, u8)>, &'a b: &'a str, (x, y): (u8, u8), f: impl Fn(u8, u8) -> bool", "rust") == ["a", "b", "()", "f"]
    assert code._params("a, b int, f func(x, y int) error, m map[string]int", "go") == ["a", "b", "f", "m"]


def test_declarations_of_go_java_and_rust_by_grammar():
    go = """package m
import (
	"fmt"
	q "a/b"
)
import "os"
func (s *Stack[T]) Push(v T, more ...func(T) error) (n int, err error) {
}
func Map[T any, U any](xs []T, f func(T) U) []U { return nil }
type Stack[T any] struct {
	Base
}
type Shape interface {
	Area() float64
}
type IDs []int
type Alias = Stack[int]
var limit = 3
r.Handle("PUT /a/{id}", h)
r.GET("/b", list)
r.Get("no path", x)
"""
    got = {(r["kind"], r["name"], tuple(r["params"])) for r in code.parse("p", "a.go", go) if r["row"] == "symbol"}
    assert got == {
        ("method", "Stack.Push", ("v", "more")), ("function", "Map", ("xs", "f")), ("class", "Stack", ()), ("interface", "Shape", ()), ("type", "IDs", ()), ("type", "Alias", ()),
        ("variable", "limit", ()), ("api", "PUT /a/{id}", ()), ("api", "GET /b", ()),
    }
    assert {"imports fmt", "imports a/b", "imports os", "extends Base"} <= found("a.go", go, "edge")
    java = """import static a.b.C.d;
@Entity(name = "x")
public sealed abstract class Box<T extends Comparable<T>> extends Base<T> implements One<T>, Two {
    @Override public Map<String, List<T>> all(final Map<String, List<T>> in, int[] k) throws IOException, X {
        if (in == null) {
            return null;
        } else if (k.length > 1) {
        }
    }
    Box(T t) {
    }
    abstract void none();
    private static <R> R[] cast(R r) {
    }
}
record Point(int x, int y) implements Shape {
}
@interface Mark {
}
"""
    got = {(r["kind"], r["name"], tuple(r["params"])) for r in code.parse("p", "B.java", java) if r["row"] == "symbol"}
    assert got == {("class", "Box", ()), ("method", "Box.all", ("in", "k")), ("method", "Box.Box", ("t",)), ("method", "Box.cast", ("r",)), ("class", "Point", ("x", "y")), ("type", "Mark", ())}
    assert {"imports a.b.C.d", "extends Base", "implements One", "implements Two", "implements Shape"} <= found("B.java", java, "edge")
    rust = """pub(crate) use a::{b, c::D};
pub struct P<'a, T: Fn(i32) -> i32> { x: &'a T }
unsafe impl<'a, T> fmt::Display for P<'a, T> where T: X {
    pub async fn show<F: Fn(u8) -> u8>(&self, f: F, (a, b): (u8, u8)) -> Result<(), E> {
    }
}
trait Shape: Debug + Clone {
    fn area(&self) -> f64;
    fn twice(&self) -> f64 { 2.0 }
}
enum E { A }
type R<T> = Result<T, E>;
"""
    got = {(r["kind"], r["name"]) for r in code.parse("p", "a.rs", rust) if r["row"] == "symbol"}
    assert got == {("class", "P"), ("method", "P.show"), ("interface", "Shape"), ("method", "Shape.twice"), ("type", "E"), ("type", "R")}
    assert {"imports a::b", "imports a::c::D", "implements Display", "extends Debug", "extends Clone"} <= found("a.rs", rust, "edge")


def test_templates_use_components_only():
    text = "<template><keep-alive><user-card/><linearGradient/><Teleport/></keep-alive></template><script setup></script>"
    assert [r["name"] for r in code.parse("p", "A.vue", text) if r["kind"] == "uses"] == ["UserCard"]


def test_lines_that_only_speak_of_passwords_and_calls(spark):
    said = [
        'passwd = "superpassword99"', 'passwd = "supersecure99"', 'x.password_hint = "the password is long"', 'pwd = "abcdefgh12" # /password/new', "<input type='password' pwd='abcdefgh12'>",
        "eval(x)", "use it without eval(x)", 're.compile("\\\\beval(x")', "assert eval(x)",
    ]
    d = spark.createDataFrame([("a.py", "\n".join(said))], "path string, text string")
    got = {(r["line"], r["rule"]) for r in S.line_findings(d).collect()}
    assert {n for n, rule in got if rule == "Password"} == {1, 2} and {n for n, rule in got if rule == "eval()"} == {6}


def test_packages_that_nothing_imports(spark):
    d = spark.createDataFrame([("p", "React"), ("p", "lodash"), ("p", "@s/x"), ("p", "left"), ("q", "react"), ("p", None), ("p", "")], "project string, name string")
    i = spark.createDataFrame([("p", "react-dom/client"), ("p", "@S\\x"), ("p", None), ("q", "vue"), ("p", "le")], "project string, target string")
    got = {(r["project"], r["name"]): r["reachable"] for r in J.reachable(d, i).collect()}
    assert got == {("p", "React"): True, ("p", "lodash"): False, ("p", "@s/x"): True, ("p", "left"): False, ("q", "react"): False}
    assert sorted(map(tuple, J.reach(J.reachable(d, i)).collect())) == [("p", 4, 2, 2, 50), ("q", 1, 0, 1, 100)]
