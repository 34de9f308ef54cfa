"""Relations of whole projects: tests of sources, changed symbols and their risk, coverage gaps, licences, frameworks, documentation, parameter flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.intervals import overlaps

#: Suffixes of script sources, test names of each language, licence texts, names and marks of frameworks.
SCRIPTS = r"\.(?:vue|tsx?|jsx?)$"
TEST_ENDS = [f".{k}.{e}" for k in ("test", "spec") for e in ("ts", "js", "tsx", "jsx")]
LICENCES = [
    ("MIT License", "MIT"), (r"Apache License,?\s*Version\s*2\.0", "Apache-2.0"), (r"GNU GENERAL PUBLIC LICENSE.*Version\s*3", "GPL-3.0"), (r"GNU GENERAL PUBLIC LICENSE.*Version\s*2", "GPL-2.0"),
    ("GNU LESSER GENERAL", "LGPL"), ("GNU AFFERO GENERAL", "AGPL-3.0"), (r"BSD\s+3[- ]Clause", "BSD-3-Clause"), (r"BSD\s+2[- ]Clause", "BSD-2-Clause"), ("ISC License", "ISC"),
    (r"Mozilla Public License.*2\.0", "MPL-2.0"), ("The Unlicense", "Unlicense"), ("Boost Software License", "BSL-1.0"), ("Eclipse Public License", "EPL"),
    ("Permission is hereby granted.*without restriction", "MIT"),
]
FRAMEWORKS = [  # name, kind, packages, marker files
    ("fastapi", "api", ["fastapi"], []),
    ("django", "api", ["django"], ["manage.py"]),
    ("flask", "api", ["flask"], []),
    ("nextjs", "ssr", ["next"], ["next.config.js", "next.config.ts", "next.config.mjs"]),
    ("nuxt", "ssr", ["nuxt"], ["nuxt.config.ts", "nuxt.config.js"]),
    ("react", "spa", ["react"], []),
    ("vue", "spa", ["vue"], []),
    ("express", "api", ["express"], []),
    ("nestjs", "api", ["@nestjs/core"], []),
    ("gin", "api", ["github.com/gin-gonic/gin"], []),
    ("echo", "api", ["github.com/labstack/echo"], []),
    ("fiber", "api", ["github.com/gofiber/fiber"], []),
    ("chi", "api", ["github.com/go-chi/chi"], []),
    ("actix", "api", ["actix-web"], []),
    ("axum", "api", ["axum"], []),
    ("flutter", "mobile", [], ["pubspec.yaml"]),
    ("react_native", "mobile", ["react-native"], []),
    ("tauri", "desktop", ["tauri", "@tauri-apps/api"], ["tauri.conf.json"]),
    ("electron", "desktop", ["electron"], []),
    ("mantine", "ui", ["@mantine/core"], []),
    ("tailwindcss", "ui", ["tailwindcss"], ["tailwind.config.js", "tailwind.config.ts"]),
    ("tanstack_query", "data", ["@tanstack/react-query"], []),
    ("openapi_fetch", "data", ["openapi-fetch"], []),
    ("react_router", "routing", ["react-router-dom"], []),
    ("lucide", "ui", ["lucide-react"], []),
]


def licence_of(text: Column) -> Column:
    """The first licence whose words a text holds; null if none."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(LICENCES):
        out = F.when(text.rlike("(?is)" + pattern), name).otherwise(out)
    return out


def frameworks(packages: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """(keys, framework, kind, version): frameworks that a declared package names or a marker file among ``files`` (keys, path) shows.

    Package names are compared without case, dashes, underscores, extras and a Go module's major version; a marker alone has no version.
    """
    flat = lambda name: name.lower().replace("-", "").replace("_", "")
    literal = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    by_package = literal([(flat(d), n) for n, _, deps, _ in FRAMEWORKS for d in deps])
    by_file = literal([(f, n) for n, _, _, marks in FRAMEWORKS for f in marks])
    kinds = literal([(n, k) for n, k, _, _ in FRAMEWORKS])
    name = F.regexp_replace(F.lower(F.regexp_replace("name", r"\[.*\]|/v\d+$", "")), "[-_]", "")
    found = packages.select(*keys, F.try_element_at(by_package, name).alias("framework"), "version")
    found = found.unionByName(files.select(*keys, F.try_element_at(by_file, F.substring_index("path", "/", -1)).alias("framework"), F.lit(None).cast("string").alias("version")))
    g = found.where("framework is not null").groupBy(*keys, "framework").agg(F.max("version").alias("version"))
    return g.select(*keys, "framework", F.element_at(kinds, F.col("framework")).alias("kind"), "version")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def test_names(path: Column) -> Column:
    """File names by which a source's test may go."""
    s = stem(path)
    python = F.array(F.concat(F.lit("test_"), s, F.lit(".py")), F.concat(s, F.lit("_test.py")))
    script = F.array(*[F.concat(s, F.lit(e)) for e in TEST_ENDS])
    return F.when(path.endswith(".py"), python).when(path.rlike(SCRIPTS), script)


def tests_of(files: DataFrame, project: str = "project", path: str = "path") -> DataFrame:
    """(project, source, test): for every source the test whose name fits it, the one nearest in depth, then shortest, then first."""
    f = files.select(F.col(project).alias("project"), F.col(path).alias("path")).distinct()
    base = F.substring_index("path", "/", -1)
    is_test = base.rlike(r"^test_.*\.py$|_test\.py$|\.(?:test|spec)\.[jt]sx?$")
    tests = f.where(is_test).select("project", F.col("path").alias("test"), base.alias("name"))
    sources = f.where(~is_test).select("project", F.col("path").alias("source"), F.explode(test_names(F.col("path"))).alias("name"))
    depth = lambda c: F.regexp_count(c, F.lit("/"))
    order = F.struct(F.abs(depth(F.col("test")) - depth(F.col("source"))), F.length("test"), F.col("test"))
    return sources.join(tests, ["project", "name"]).groupBy("project", "source").agg(F.min_by("test", order).alias("test"))


def change_kind(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """(keys, change) of signatures (keys, params, returns, digest): added, deleted, signature_change, return_type_change, body_change; equal ones are left out."""
    o = old.select(*keys, *[F.col(c).alias("o_" + c) for c in ("params", "returns", "digest")])
    n = new.select(*keys, *[F.col(c).alias("n_" + c) for c in ("params", "returns", "digest")])
    change = (
        F.when(F.col("o_digest").isNull(), "added").when(F.col("n_digest").isNull(), "deleted").when(~F.col("o_params").eqNullSafe(F.col("n_params")), "signature_change")
        .when(~F.col("o_returns").eqNullSafe(F.col("n_returns")), "return_type_change").when(F.col("o_digest") != F.col("n_digest"), "body_change")
    )
    return o.join(n, list(keys), "full_outer").withColumn("change", change).where("change is not null").select(*keys, "change")


def change_risk(callers: Column, change: Column) -> Column:
    """safe without callers; low for bodies and up to 3 callers, moderate up to 10, else high."""
    return F.when(callers == 0, "safe").when((change == "body_change") | (callers <= 3), "low").when(callers <= 10, "moderate").otherwise("high")


def changed_symbols(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Distinct (path, id) of symbols (path, id, start, end) that a changed range (path, start, end) touches."""
    return overlaps(symbols, ranges, "path").select("path", "id").distinct()


def coverage_gaps(covered: DataFrame) -> DataFrame:
    """Rows (total, covered, refs) with ``gap``: the uncovered share, weighed by one and the references."""
    return covered.withColumn("gap", F.round((1 - F.col("covered") / F.col("total")) * (1 + F.col("refs")), 6))


def documentation(readme: Column, api: Column, module: Column, inline: Column, env: Column, changelog: Column, contributing: Column) -> Column:
    """0 to 100 from shares of 0 to 1, and 3 and 2 points for a changelog and a guide."""
    score = 100 * (0.30 * readme + 0.20 * api + 0.15 * module + 0.25 * inline + 0.10 * env) + F.when(changelog, 3).otherwise(0) + F.when(contributing, 2).otherwise(0)
    return F.round(F.least(score, F.lit(100.0)), 6)


def parameter_edges(calls: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Calls (source, target) into symbols (id, params) one of whose parameters holds ``name``, without case."""
    takes = symbols.where(F.exists("params", lambda p: F.contains(F.lower(p), F.lit(name.lower())))).select(F.col("id").alias("target"))
    return calls.select("source", "target").distinct().join(takes.distinct(), "target").select("source", "target")


# ---------------------------------------------------------------- declared and imported packages


def reachable(declared: DataFrame, imports: DataFrame) -> DataFrame:
    """(project, name, reachable) of ``declared`` packages (project, name): whether an import of the project (project, target) holds the name, case aside.

    Imports are cut into their pieces of the lengths that names have, so that
    containment is an equi-join. A null or empty name is no package.
    """
    d = declared.where("name is not null and name <> ''").select("project", "name").distinct().withColumn("piece", F.lower("name"))
    lengths = d.groupBy("project").agg(F.collect_set(F.length("piece")).alias("lengths"))
    i = imports.where("target is not null and target <> ''").select("project", F.explode(F.array_distinct(F.array(F.lower("target"), F.replace(F.lower("target"), F.lit("\\"), F.lit("/"))))).alias("t")).distinct()
    i = i.join(lengths, "project").select("project", "t", F.explode("lengths").alias("n")).where("n <= length(t)")
    pieces = i.select("project", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - F.col("n") + 1), lambda k: F.substring(F.col("t"), k, F.col("n")))).alias("piece")).distinct()
    return d.join(pieces.withColumn("hit", F.lit(True)), ["project", "piece"], "left").select("project", "name", F.coalesce("hit", F.lit(False)).alias("reachable"))


def reach(found: DataFrame) -> DataFrame:
    """(project, total, reachable, unreachable, pct) of ``reachable``'s rows; pct is the whole percentage that nothing imports, halves to even."""
    g = found.groupBy("project").agg(F.count("*").alias("total"), F.count_if("reachable").alias("reachable")).withColumn("unreachable", F.col("total") - F.col("reachable"))
    return g.withColumn("pct", F.bround(F.col("unreachable") / F.col("total") * 100, 0).cast("int"))
