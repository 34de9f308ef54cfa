"""Which file of its project an import means: relative paths, configured prefixes, module paths.

Questions are distinct (project, folder, module). Relative paths are folded as
expressions; a module is exploded to its prefixes, which meet the configured
ones in an equi-join, and the longest wins. A candidate path meets the files
under the names that they can be imported by; of several files the best kind of
name, then the least path is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions that a path may lack, and files that stand for their folder, in the order in which they are tried.
EXTENSIONS = [".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".go"]
INDEX_FILES = ["index.ts", "index.tsx", "index.js", "index.jsx", "__init__.py"]
#: Files that configure prefixes.
CONFIGS = ["tsconfig.json", "tsconfig.app.json", "tsconfig.base.json"]
#: Prefixes that lead to prefixes are followed so often.
HOPS = 4
#: Names of the stages, in their order.
STAGES = ["relative", "alias", "module"]


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def folded(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; what leads out of the project keeps its ``..``."""
    empty = F.array().cast("array<string>")
    up = lambda a: (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("")), a), -1) != "..")
    step = lambda a, x: F.when(x.isin("", "."), a).when((x == "..") & up(a), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def relative_path(folder: Column, module: Column) -> Column:
    """The path of a relative import, dotted or with slashes; null for others."""
    at = F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/")))
    dots = F.length(F.regexp_extract(module, r"^(\.+)", 1))
    dotted = F.concat(at, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), F.replace(F.expr("substring(module, length(regexp_extract(module, '^([.]+)', 1)) + 1)"), F.lit("."), F.lit("/")))
    slashed = module.startswith("./") | module.startswith("../")
    return F.when(slashed, folded(F.concat(at, module))).when(module.startswith("."), folded(dotted))


def configured(files: DataFrame) -> DataFrame:
    """(project, prefix, target, exact) that configuration files (project, path, text) declare: ``a/*`` to the first ``b/*``, others exactly.

    Of one prefix the first configuration file in ``CONFIGS`` counts; text that is no JSON declares nothing.
    """
    kind = "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>"
    turn = F.array_position(F.array(*map(F.lit, CONFIGS)), F.col("path"))
    plain = F.regexp_replace(F.regexp_replace("text", r"(?m)(^|[\s,{\[])//[^\n]*", "$1"), r"(?s)/\*(?=[\s*]).*?\*/", "")
    j = files.where(F.col("path").isin(CONFIGS)).select("project", turn.alias("turn"), F.from_json(plain, kind)["compilerOptions"].alias("o"))
    p = j.select("project", "turn", F.coalesce("o.baseUrl", F.lit(".")).alias("base"), F.explode("o.paths").alias("alias", "targets")).where(F.size("targets") > 0)
    wild = F.col("alias").endswith("/*") & F.col("targets")[0].endswith("/*")
    strip = lambda c: F.regexp_replace(c, r"/\*\z", "")
    target = folded(F.concat_ws("/", "base", F.when(wild, strip(F.col("targets")[0])).otherwise(F.col("targets")[0])))
    rows = p.where(wild | ~F.col("alias").contains("*")).select("project", F.when(wild, strip(F.col("alias"))).otherwise(F.col("alias")).alias("prefix"), F.struct("turn", target.alias("target"), (~wild).alias("exact")).alias("c"))
    return rows.groupBy("project", "prefix").agg(F.min("c").alias("c")).select("project", "prefix", "c.target", "c.exact")


def go_modules(files: DataFrame) -> DataFrame:
    """(project, prefix) that go.mod names."""
    m = files.where("path = 'go.mod'").select("project", F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1).alias("prefix"))
    return m.where("prefix <> ''").groupBy("project").agg(F.min("prefix").alias("prefix"))


def _prefixes(module: Column) -> Column:
    """``a/b/c`` as a, a/b and a/b/c."""
    parts = F.split(module, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def longest(asked: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(project, module, prefix, rest, ...) of ``asked`` (project, module): its longest prefix of ``prefixes`` (project, prefix, ...), whole segments only."""
    more = [c for c in prefixes.columns if c not in ("project", "prefix")]
    exact = F.col("exact") if "exact" in more else F.lit(False)
    hits = asked.select("project", "module", F.explode(_prefixes(F.col("module"))).alias("prefix")).join(prefixes, ["project", "prefix"]).where(~exact | (F.col("prefix") == F.col("module")))
    best = hits.groupBy("project", "module").agg(F.max(F.struct(F.length("prefix").alias("n"), "prefix", *more)).alias("c"))
    rest = F.expr("ltrim('/', substring(module, c.n + 1))")
    return best.select("project", "module", "c.prefix", rest.alias("rest"), *[f"c.{x}" for x in more])


def _keys(files: DataFrame) -> DataFrame:
    """(project, how, key, rank, path): the names that files can be imported by."""
    base = F.element_at(F.split("path", "/"), -1)
    ext = F.regexp_extract(base, r"(?s).(\.[^.]*)\z", 1)
    at = lambda names, c: F.array_position(F.array(*map(F.lit, names)), c)
    key = lambda how, c, rank, when: F.when(when, F.struct(F.lit(how).alias("how"), c.alias("key"), rank.cast("int").alias("rank")))
    go = (ext == ".go") & F.lit(True)
    keys = F.array(
        key("path", F.col("path"), F.lit(0), F.lit(True)),
        key("stem", F.expr("regexp_replace(path, '[.][^./]*$', '')"), at(EXTENSIONS, ext), at(EXTENSIONS, ext) > 0),
        key("folder", folder_of(F.col("path")), at(INDEX_FILES, base) + len(EXTENSIONS), at(INDEX_FILES, base) > 0),
        key("package", folder_of(F.col("path")), F.when(base.endswith("_test.go"), 1).otherwise(0), go),
    )
    return files.select("project", "path", F.inline(F.filter(keys, lambda k: k.isNotNull())))


def _probed(asked: DataFrame, keys: DataFrame, package: bool = False) -> DataFrame:
    """(project, at, found) of candidate paths ``asked`` (project, at)."""
    c = F.col("at")
    if package:
        names = F.array(F.struct(F.lit("package").alias("how"), c.alias("key")))
    else:
        # a path that ends in some extension is looked for with another in its place, as compiled names are
        stem = F.expr("regexp_replace(at, '(?<=[^/])[.][^./]*$', '')")
        names = F.array(F.struct(F.lit("path").alias("how"), c.alias("key")), F.struct(F.lit("stem").alias("how"), stem.alias("key")), F.struct(F.lit("folder").alias("how"), c.alias("key")))
    hit = asked.select("project", "at").distinct().select("project", "at", F.inline(names)).join(keys, ["project", "how", "key"])
    return hit.groupBy("project", "at").agg(F.min(F.struct("rank", "path")).alias("c")).select("project", "at", F.col("c.path").alias("found"))


def resolve(imports: DataFrame, files: DataFrame, aliases: DataFrame, modules: DataFrame) -> DataFrame:
    """(project, path, module, line, found, stage) of ``imports`` (project, path, module, line); null where no file of the project is meant.

    ``files`` are (project, path), ``aliases`` (project, prefix, target,
    exact), ``modules`` (project, prefix) of Go. Relative paths come first,
    then the longest alias, whose target may begin with another one, then the
    module path for Go files. Aliases that lead round in a circle mean
    nothing; a null module means nothing.
    """
    keys = _keys(files.where("path is not null").select("project", "path").distinct())
    i = imports.withColumn("folder", folder_of(F.col("path"))).withColumn("go", F.col("path").endswith(".go"))
    q = ["project", "folder", "module", "go"]
    asked = i.where("module is not null and path is not null").select(*q).distinct()
    near = asked.withColumn("at", relative_path(F.col("folder"), F.col("module"))).where("at is not null")
    one = near.join(_probed(near, keys), ["project", "at"]).select(*q, "found")
    walk = asked.select("project", "module").distinct().select("project", "module", F.col("module").alias("origin"), F.array().cast("array<string>").alias("seen"))
    two = None
    for _ in range(HOPS):
        step = longest(walk.select("project", "module").distinct(), aliases).withColumn("at", folded(F.concat_ws("/", "target", "rest"))).select("project", "module", "prefix", "at")
        walk = walk.join(step, ["project", "module"]).where(~F.array_contains("seen", F.col("prefix"))).select("project", "origin", "at", F.concat("seen", F.array("prefix")).alias("seen"))
        hit = walk.join(_probed(walk, keys), ["project", "at"]).select("project", F.col("origin").alias("module"), F.size("seen").alias("hops"), "found")
        two = hit if two is None else two.union(hit)
        walk = walk.select("project", F.col("at").alias("module"), "origin", "seen")
    two = asked.join(two.groupBy("project", "module").agg(F.min(F.struct("hops", "found")).alias("c")), ["project", "module"]).select(*q, F.col("c.found").alias("found"))
    paths = longest(asked.where("go").select("project", "module").distinct(), modules).select("project", "module", F.col("rest").alias("at"))
    three = asked.where("go").join(paths, ["project", "module"]).join(_probed(paths, keys, package=True), ["project", "at"]).select(*q, "found")
    every = None
    for turn, rows in enumerate((one, two, three)):
        rows = rows.select(*q, F.struct(F.lit(turn).alias("turn"), "found").alias("c"))
        every = rows if every is None else every.union(rows)
    best = every.groupBy(*q).agg(F.min("c").alias("c"))
    out = i.join(best, q, "left")
    return out.select("project", "path", "module", "line", F.col("c.found").alias("found"), F.when(F.col("c.found").isNotNull(), F.element_at(F.array(*map(F.lit, STAGES)), F.col("c.turn") + 1)).alias("stage"))
