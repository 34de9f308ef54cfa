"""Files in, tables out: source trees as rows, stored indexes, line-delimited contents, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are no source, and the largest file that is read.
IGNORED = r"(^|/)(?:node_modules|__pycache__|\.git|dist|build|\.venv|venv|\.nuxt|\.output)(/|$)"
LARGEST = 1 << 20
#: The category of a lower-case path, first fit wins.
CATEGORIES = [
    ("api", r"/api/|_api\.(?:py|js)$"), ("composable", "/composable"), ("component", "/component"), ("service", "/service"), ("store", "/store"), ("view", "/view|/pages/"), ("util", "/util|/helpers/"),
    ("model", "/model"), ("test", "/test|^test"), ("config", "/config"), ("middleware", "/middleware"), ("route", "/route"), ("gateway", "/gateway"), ("repository", "/repositor"),
]


def read_tree(spark: SparkSession, root: str, extensions: list[str], largest: int = LARGEST) -> DataFrame:
    """(path, text, digest, lines, modified) of the files below ``root``: relative paths, sizes pruned by the reader.

    Bytes that are no UTF-8 are left out, and so are empty files, which the reader never lists.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= largest)
    at = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    base = F.regexp_replace(F.lit(root), r"^[a-z]+:/*", "/")
    f = f.withColumn("path", F.ltrim(F.substring(at, F.length(base) + 1, F.length(at)), F.lit("/")))
    f = f.where(F.lower(F.substring_index("path", ".", -1)).isin(extensions) & ~F.col("path").rlike(IGNORED))
    f = f.withColumn("text", F.try_validate_utf8(F.col("content").cast("string"))).where(F.col("text").isNotNull())
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1)))
    return f.select("path", "text", F.substring(F.sha2("content", 256), 1, 16).alias("digest"), lines.alias("lines"), F.col("modificationTime").alias("modified"))


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Symbols (id, name, type, path, start_line) and dependencies (id, source, target, type) of stored ``index.json`` files, plain or gzipped."""
    symbol, dependency = "struct<name: string, type: string, path: string, start_line: int>", "struct<source: string, target: string, type: string>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"symbols map<string, {symbol}>, dependencies map<string, {dependency}>").alias("j"))
    tables = (whole.select(F.explode(f"j.{t}").alias("id", "v")).select("id", "v.*") for t in ("symbols", "dependencies"))
    return tuple(tables)


def merged(newer: DataFrame, older: DataFrame, *keys: str) -> DataFrame:
    """Rows of both; of one key the newer's."""
    return older.join(newer.select(*keys).distinct(), list(keys), "left_anti").unionByName(newer, allowMissingColumns=True)


def with_content(symbols: DataFrame, contents: DataFrame) -> DataFrame:
    """Symbols whose own content is null get that of ``contents`` (id, content)."""
    c = contents.groupBy("id").agg(F.max("content").alias("stored"))
    return symbols.join(c, "id", "left").withColumn("content", F.coalesce("content", "stored")).drop("stored")


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet below ``folder``; a table appears whole or not at all, by the committer's rename."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def export(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as line-delimited JSON below ``folder``."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def category(path: Column) -> Column:
    """The category of a file; ``module`` if none fits."""
    out = F.lit("module")
    for name, pattern in reversed(CATEGORIES):
        out = F.when(F.lower(path).rlike(pattern), name).otherwise(out)
    return out


def code_map(files: DataFrame, path: str = "path") -> DataFrame:
    """(category, folder, files) counts."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    return files.groupBy(category(F.col(path)).alias("category"), folder.alias("folder")).agg(F.count("*").alias("files"))


def file_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (source, target) of files from resolved symbol edges; edges inside a file are left out."""
    s = symbols.select("id", "path")
    e = edges.join(s.select(F.col("id").alias("source"), F.col("path").alias("a")), "source").join(s.select(F.col("id").alias("target"), F.col("path").alias("b")), "target")
    return e.where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target")).distinct()
