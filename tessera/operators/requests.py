"""Risk of change requests from their unified diffs, and what they reach.

A diff is one row (id, text). It is cut into files and lines inside the row,
so that nothing is shuffled before the one sum per request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import scope

#: Lines and paths that show what a change touches.
API_LINES = [
    r"(?i)@(app|router)\.(get|post|put|delete|patch|head|options)\s*\(",
    r"(?i)\.(Get|Post|Put|Delete|Patch|Head|Options)\s*\(",
    r"(router|app)\.(use|route|all)\s*\(",
    r"@(Get|Post|Put|Delete|Patch|Head|Options|RequestMapping)\s*\(",
]
API_PATHS = ["/api/", "/routes/", "/router/", "/endpoints/", "/controllers/"]
AUTH_LINES = [
    r"(?i)(auth|authenticate|authorization|login|logout|session|token|jwt|oauth)",
    r"(?i)(password|credential|secret|apikey|api_key)",
    r"(?i)(permission|rbac|role|acl|privilege)",
]
AUTH_PATHS = ["auth", "security", "permission", "login", "session"]
DB_LINES = [
    r"(?i)(migration|migrate|alembic|schema|model)",
    r"(?i)(CREATE\s+TABLE|ALTER\s+TABLE|DROP\s+TABLE)",
    r"(?i)(db\.|database|sqlalchemy|sequelize|prisma|mongoose|typeorm)",
]
DB_PATHS = ["migration", "models/", "schema", "alembic", "prisma"]
CONFIG_FILES = [
    r"^\.env",
    r"(?i)(config|settings|configuration)\.(py|ts|js|json|yaml|yml|toml)$",
    r"^docker-compose",
    r"^Dockerfile",
    r"(\.github/workflows|\.gitlab-ci|Jenkinsfile|\.circleci)",
]
SIGNATURES = {
    "python": r"(?m)^\s*def\s+(\w+)\s*\((.*?)\)",
    "typescript": r"(?m)(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\((.*?)\)",
    "go": r"(?m)func\s+(?:\([^)]+\)\s+)?(\w+)\s*\((.*?)\)",
}
EXPORTED = r"export\s+(?:default\s+)?(?:function|class|const|let|var|type|interface)\s+(\w+)"
SUFFIXES = {"python": ["py"], "typescript": ["ts", "tsx", "js", "jsx", "mjs"], "go": ["go"]}
#: Points of what a request touches, and of its files' number.
POINTS = {"api": 15, "auth": 20, "db": 15, "config": 10, "breaking": 20}
SIZES = [(20, 20), (10, 10), (5, 5)]
LEVELS = [(70, "critical"), (45, "high"), (20, "medium")]


def changed_files(diffs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, file, added, deleted): the lines of every file of each diff, without their signs. Null and empty diffs have none."""
    sections = F.slice(F.split(F.concat(F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), r"\ndiff --git "), 2, 1 << 30)
    d = diffs.select(F.col(key), F.explode(F.transform(sections, lambda s: F.split(s, "\n"))).alias("l"))
    named = lambda sign: F.try_element_at(F.transform(F.filter("l", lambda x: x.startswith(sign)), lambda x: F.substr(x, F.lit(7))), F.lit(1))
    body = lambda sign, head: F.transform(F.filter("l", lambda x: x.startswith(sign) & ~x.startswith(head)), lambda x: F.substr(x, F.lit(2)))
    return d.select(key, F.coalesce(named("+++ b/"), named("--- a/")).alias("file"), body("+", "+++").alias("added"), body("-", "---").alias("deleted")).where("file is not null")


def _hits(lines: Column, patterns: list[str]) -> Column:
    """How many of the patterns lines meet, summed over the lines."""
    meets = lambda p: lambda x: x.rlike(p)
    return sum((F.size(F.filter(lines, meets(p))) for p in patterns), F.lit(0))


def _path_has(path: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.lower(path).contains(p)
    return out


def touched(files: DataFrame) -> DataFrame:
    """Adds api, auth, db and config: what the lines or the path of each file touch; auth wants two hits."""
    lines, path = F.concat("added", "deleted"), F.col("file")
    config = F.lit(False)
    for p in CONFIG_FILES:
        config = config | path.rlike(p) | F.element_at(F.split(path, "/"), -1).rlike(p)
    return (
        files.withColumn("api", (_hits(lines, API_LINES) > 0) | _path_has(path, API_PATHS)).withColumn("auth", (_hits(lines, AUTH_LINES) >= 2) | _path_has(path, AUTH_PATHS))
        .withColumn("db", (_hits(lines, DB_LINES) > 0) | _path_has(path, DB_PATHS)).withColumn("config", config)
    )


def breaking(files: DataFrame, key: str = "id") -> DataFrame:
    """(key, file, symbol, type) of functions that are gone or take another number of parameters, and of exports that are gone."""
    ext = F.element_at(F.split("file", r"\."), -1)
    old, new = F.array_join("deleted", "\n"), F.array_join("added", "\n")
    sigs = lambda text, p: F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("params"))
    number = lambda p: F.size(F.filter(F.split(p, ","), lambda x: F.trim(x) != ""))
    parts = []
    for language, pattern in SIGNATURES.items():
        f = files.where(F.lower(ext).isin(SUFFIXES[language])).select(key, "file", sigs(old, pattern).alias("old"), sigs(new, pattern).alias("new"), old.alias("o"), new.alias("n"))
        each = f.select(key, "file", "new", F.explode("old").alias("s")).groupBy(key, "file", "new", F.col("s.name").alias("symbol")).agg(F.last("s.params").alias("params"))
        same = F.filter("new", lambda x: x["name"] == F.col("symbol"))
        kind = F.when(F.size(same) == 0, "deletion").when(number(F.element_at(same, -1)["params"]) != number(F.col("params")), "signature_change")
        parts.append(each.select(key, "file", "symbol", kind.alias("type")).where("type is not null"))
        if language == "typescript":
            gone = F.array_except(F.regexp_extract_all("o", F.lit(EXPORTED), F.lit(1)), F.regexp_extract_all("n", F.lit(EXPORTED), F.lit(1)))
            gone = f.select(key, "file", F.explode(gone).alias("symbol")).join(parts[-1].select(key, "file", "symbol"), [key, "file", "symbol"], "left_anti")
            parts.append(gone.select(key, "file", "symbol", F.lit("export_removed").alias("type")))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def risk(diffs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, files, added, deleted, touches, score, level) of every request that changes a file; scores are at most 100."""
    f = touched(changed_files(diffs, key, text))
    broken = breaking(f, key).select(key).distinct().withColumn("breaking", F.lit(True))
    flags = ["api", "auth", "db", "config"]
    g = f.groupBy(key).agg(F.count("*").alias("files"), F.sum(F.size("added")).alias("added"), F.sum(F.size("deleted")).alias("deleted"), *[F.max(x).alias(x) for x in flags])
    g = g.join(broken, key, "left").fillna(False, ["breaking"])
    size = F.lit(0)
    for most, points in reversed(SIZES):
        size = F.when(F.col("files") > most, points).otherwise(size)
    score = size + F.when((F.col("added") > 0) & (F.col("deleted") > 2 * F.col("added")), 10).otherwise(0)
    for flag, points in POINTS.items():
        score = score + F.when(F.col(flag), points).otherwise(0)
    level = F.lit("low")
    for least, name in reversed(LEVELS):
        level = F.when(F.col("score") >= least, name).otherwise(level)
    touches = F.array_join(F.filter(F.array(*[F.when(F.col(x), F.lit(x)) for x in POINTS]), lambda x: x.isNotNull()), ",")
    return g.withColumn("score", F.least(score, F.lit(100))).select(key, "files", "added", "deleted", touches.alias("touches"), "score", level.alias("level"))


def reached(files: DataFrame, symbols: DataFrame, callers: DataFrame, key: str = "id") -> DataFrame:
    """(key, caller_id, path): symbols outside the changed files that call what is inside. ``symbols`` (id, path), ``callers`` (symbol_id, caller_id).

    Where files, symbols and callers have a project, it is part of every key and of the result.
    """
    own = scope(files, symbols, callers)
    f = files.select(key, *own, F.col("file").alias("path")).distinct()
    inside = f.join(symbols.select(*own, F.col("id").alias("symbol_id"), "path"), [*own, "path"]).select(key, *own, "symbol_id")
    out = inside.join(callers, [*own, "symbol_id"]).join(symbols.select(*own, F.col("id").alias("caller_id"), "path"), [*own, "caller_id"]).select(key, *own, "caller_id", "path").distinct()
    return out.join(f, [key, *own, "path"], "left_anti").select(key, *own, "caller_id", "path")


def suggested_tests(files: DataFrame, paths: DataFrame, key: str = "id") -> DataFrame:
    """(key, test): the files of ``paths`` (path) whose names say that they test one of ``files`` (key, file): equi-joins on the ends of paths."""
    last = F.element_at(F.split("file", "/"), -1)
    folder = F.regexp_extract("file", r"^(.*/)[^/]*$", 1)
    stem, ext = F.regexp_replace(last, r"\.[^.]*$", ""), F.regexp_extract(last, r"(\.[^.]*)$", 1)
    named = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    wanted = F.array(
        named(folder, "test_", stem, ext), named(folder, stem, "_test", ext), named("tests/test_", stem, ext), named("tests/", folder, "test_", stem, ext), named(folder, stem, ".test", ext),
        named(folder, stem, ".spec", ext), named(folder, "__tests__/", stem, ".test", ext), named(folder, "__tests__/", stem, ext), named(folder, stem, "_test.go"),
    )
    w = files.select(key, F.explode(F.array_distinct(wanted)).alias("end"))
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return w.join(paths.select("path", F.explode(ends).alias("end")), "end").select(key, F.col("path").alias("test")).distinct()


# ---------------------------------------------------------------- clusters of changes

#: Files that say nothing about what belongs together.
NOISE_FILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "poetry.lock", "Pipfile.lock", "Cargo.lock",
    ".gitignore", ".eslintrc", ".prettierrc",
    "CHANGELOG.md", "LICENSE",
]
NOISE_FOLDERS = ["node_modules/", "dist/", "build/", "__pycache__/", ".git/"]


def is_noise(path: Column) -> Column:
    last = F.element_at(F.split(path, "/"), -1)
    out = last.isin(NOISE_FILES) | last.startswith(".")
    for folder in NOISE_FOLDERS:
        out = out | path.contains(folder)
    return out


def category(files: Column) -> Column:
    """What a cluster of files (an array of paths) is about."""
    has = lambda *parts: F.exists(files, lambda f: _path_has(f, list(parts)))
    test, route, schema = has("test"), has("route", "api/"), has("schema", "model", "type")
    ui = F.exists(files, lambda f: f.rlike(r"\.(vue|tsx|jsx)$"))
    out = F.when(route & schema, "api_endpoint").when(ui & test, "component_with_test").when(route & ui, "feature_slice")
    return out.when(has("i18n", "locale"), "i18n_bundle").when(has("config", "setting"), "config_change").when(test, "code_with_test").otherwise("coupled_files")


# ---------------------------------------------------------------- answers of interfaces

#: Folders of interfaces, folders that are passed over, keys that should be called something else.
API_FOLDERS = ["api", "routes", "routers", "endpoints", "views"]
PASSED_OVER = ["node_modules", "__pycache__", ".git", "dist", "build", ".venv", "venv", ".nuxt", ".output", "test", "tests", "__tests__"]
WRONG_KEYS = {
    "success": "ok", "status": "ok", "result": "data", "results": "data", "msg": "message", "err": "error", "errMsg": "error", "error_message": "error", "errorMessage": "error",
}


def answers(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, code, issue, suggestion) of every line of an interface's file that returns an object; the last two are null where it keeps the form.

    One line can be two answers, as a return and as a response.
    """
    p = F.col(path)
    skipped = F.lit(False)
    for part in PASSED_OVER:
        skipped = skipped | p.contains(part)
    api = F.arrays_overlap(F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")), F.lit(1))), F.array(*map(F.lit, API_FOLDERS)))
    ext = F.element_at(F.split(p, r"\."), -1)
    f = files.where(ext.isin("py", "ts", "js") & api & ~skipped & F.col(text).isNotNull()).select(p.alias("path"), (ext == "py").alias("py"), F.posexplode(F.split(text, "\n")).alias("at", "raw"))
    code, py = F.trim("raw"), F.col("py")
    times = F.when(py, code.contains("return").cast("int") + code.contains("JSONResponse").cast("int")).otherwise((code.contains("return") | code.contains("res.json") | code.contains("res.send")).cast("int"))
    f = f.where(code.contains("{") & ~code.startswith(F.when(py, "#").otherwise("//"))).select("path", "py", (F.col("at") + 1).alias("line"), code.alias("code"), F.explode(F.array_repeat(F.lit(1), times)).alias("_"))
    obj = F.regexp_extract("code", r"\{[^}]+\}", 0)
    wrong = F.lit(None).cast("string")
    for key, right in reversed(WRONG_KEYS.items()):
        here = F.when(py, obj.rlike(rf"(?i)[\"']?{key}[\"']?\s*:")).otherwise(obj.rlike(rf"(?i)\b{key}\s*:"))
        wrong = F.when(here, f'Use "{right}" instead of "{key}"').otherwise(wrong)
    has = lambda key: F.when(py, obj.contains(f'"{key}"') | obj.contains(f"'{key}'")).otherwise(obj.contains(f"{key}:") | obj.contains(f"{key} :"))
    lacks = (obj != "") & ~has("ok") & (has("data") | has("error"))
    issue = F.when(wrong.isNotNull(), "wrong_key").when(lacks, "missing_ok")
    advice = F.coalesce(wrong, F.when(lacks, F.when(py, 'Add "ok": True/False to the response').otherwise('Add "ok: true/false" to the response')))
    return f.select("path", "line", F.substring("code", 1, 80).alias("code"), issue.alias("issue"), advice.alias("suggestion"))


def compliance(found: DataFrame) -> DataFrame:
    """(answers, issues, rate): the share of answers that keep the form, in percent; 100 if there are none."""
    g = found.agg(F.count("*").alias("answers"), F.count("issue").alias("issues"))
    return g.withColumn("rate", F.when(F.col("answers") == 0, 100.0).otherwise((F.col("answers") - F.col("issues")) / F.col("answers") * 100))
