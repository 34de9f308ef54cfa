"""A stored index in generations: files, symbols, edges, their resolution and callers, refreshed by what changed.

Every table is dealt into buckets by (project, path). A generation holds the
buckets that it rewrote; its manifest tells for each table and bucket which
generation's rows stand. A manifest is written aside and renamed into place,
so a generation is there whole or not at all, and of two writers of one
generation the second fails. A refresh reads all files' digests, scans the
changed ones, finds the files whose names may now mean something else, and
rewrites the buckets of these; others stay where they were written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shared import written
from tessera.operators.changes import detect_changes
from tessera.operators.resolution import affected, callers, path_of, resolved
from tessera.sources import code

#: Columns of the stored tables; the first two are their files'.
TABLES = {
    "files": "project string, path string, digest string",
    "symbols": "project string, path string, id string, kind string, name string, start_line int, end_line int, params array<string>, returns string, summary string, language string",
    "edges": "project string, path string, source string, target string, type string, line int, names array<string>",
    "resolved": "project string, path string, source string, target string, type string, found string, stage string",
    "callers": "project string, path string, symbol_id string, caller_id string",
}
#: Buckets of a new index.
BUCKETS = 64
FILE = ["project", "path"]


# ---------------------------------------------------------------- the pointer


def _fs(spark: SparkSession, root: str):
    """The Hadoop file system of ``root``, and its way to name a path."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def current(spark: SparkSession, root: str) -> int | None:
    """The newest generation whose manifest stands; None where there is no index."""
    fs, path = _fs(spark, root)
    at = path(f"{root}/manifests")
    if not fs.exists(at):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return max((int(n) for n in names if n.isdigit()), default=None)


def _manifest(spark: SparkSession, root: str, generation: int) -> dict[tuple[str, int], int]:
    """(table, bucket) to the generation whose rows stand; as many entries as there are tables and buckets."""
    rows = spark.read.schema("name string, bucket int, generation int").json(f"{root}/manifests/{generation}")
    return {(r["name"], r["bucket"]): r["generation"] for r in rows.collect()}


def _publish(spark: SparkSession, root: str, generation: int, entries: dict[tuple[str, int], int]) -> None:
    fs, path = _fs(spark, root)
    aside = f"{root}/aside/{uuid.uuid4().hex}"
    spark.createDataFrame([(t, b, g) for (t, b), g in sorted(entries.items())], "name string, bucket int, generation int").coalesce(1).write.json(aside)
    fs.mkdirs(path(f"{root}/manifests"))
    target = path(f"{root}/manifests/{generation}")
    if fs.exists(target) or not fs.rename(path(aside), target):
        raise RuntimeError(f"generation {generation} of {root} was published by another writer")


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("project", "path"), F.lit(buckets)).cast("int")


def read(spark: SparkSession, root: str, table: str, generation: int | None = None) -> DataFrame:
    """A table of a generation, the newest if none is named; at most one folder a bucket is read, however many generations there were."""
    generation = current(spark, root) if generation is None else generation
    if generation is None:
        raise ValueError(f"no index at {root}")
    paths = [f"{root}/data/{table}/{g}/bucket={b}" for (t, b), g in sorted(_manifest(spark, root, generation).items()) if t == table and g >= 0]
    if not paths:
        return spark.createDataFrame([], TABLES[table])
    return spark.read.schema(TABLES[table]).parquet(*paths)


def _write(df: DataFrame, root: str, table: str, generation: int, buckets: int) -> set[int]:
    """Rows of a table written below the generation; the buckets that have some."""
    names = [c.split()[0] for c in TABLES[table].split(", ")]
    df = df.select(*names).withColumn("bucket", bucket_of(buckets))
    at = f"{root}/data/{table}/{generation}"
    # two files a bucket: a large project's bucket is no single task
    df.repartition("bucket", F.pmod(F.xxhash64(*names), F.lit(2))).sortWithinPartitions("bucket", *FILE).write.mode("overwrite").partitionBy("bucket").parquet(at)
    fs, path = _fs(df.sparkSession, root)
    return {int(n.split("=")[1]) for s in fs.listStatus(path(at)) if (n := s.getPath().getName()).startswith("bucket=")}


# ---------------------------------------------------------------- building and refreshing


def _digests(files: DataFrame) -> DataFrame:
    return files.where("path is not null and text is not null").select("project", "path", F.sha2("text", 256).alias("digest"))


def _scanned(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = written(code.scan(files), "scan")
    return code.symbols(rows), code.edges(rows).withColumn("path", path_of(F.col("source")))


def build(spark: SparkSession, root: str, files: DataFrame, buckets: int = BUCKETS) -> int:
    """A whole new generation from ``files`` (project, path, text), one row a file; its number."""
    generation = (current(spark, root) or 0) + 1
    files = files.select("project", "path", "text")
    symbols, edges = _scanned(files)
    tables = {"files": _digests(files), "symbols": symbols, "edges": edges}
    found = written(resolved(symbols, edges), "resolved")
    tables |= {"resolved": found.withColumn("path", path_of(F.col("source"))), "callers": callers(symbols, edges, found).withColumn("path", path_of(F.col("caller_id")))}
    entries = {(t, b): -1 for t in TABLES for b in range(buckets)}
    for t, df in tables.items():
        entries |= {(t, b): generation for b in _write(df, root, t, generation, buckets)}
    _publish(spark, root, generation, entries)
    return generation


def refresh(spark: SparkSession, root: str, files: DataFrame) -> int:
    """A generation that tells of ``files`` -- all there are now -- what ``build`` would; its number, the current one if nothing changed.

    Files are compared by digest. A renamed file is one that went and one
    that came. Only buckets that hold a changed file, or a file of which
    ``affected`` says that its names may mean something else, are written.
    """
    last = current(spark, root)
    if last is None:
        return build(spark, root, files)
    manifest = _manifest(spark, root, last)
    buckets = 1 + max(b for _, b in manifest)
    generation = last + 1
    at = {t: read(spark, root, t, last) for t in TABLES}
    files = files.select("project", "path", "text")
    now = _digests(files)
    key = lambda df: df.withColumn("file", F.struct(*FILE))
    changed = written(detect_changes(key(at["files"]), key(now), "file", "digest").select("file.project", "file.path", "change"), "changed")
    if changed.isEmpty():
        return last
    live = changed.where("change <> 'deleted'").select(*FILE)
    fresh_symbols, fresh_edges = _scanned(files.join(live, FILE, "left_semi"))
    names = lambda t: [c.split()[0] for c in TABLES[t].split(", ")]
    symbols = written(at["symbols"].join(changed, FILE, "left_anti").unionByName(fresh_symbols.select(*names("symbols"))), "symbols")
    edges = written(at["edges"].join(changed, FILE, "left_anti").unionByName(fresh_edges.select(*names("edges"))), "edges")
    moved = written(affected(at["symbols"].unionByName(symbols), at["edges"].unionByName(edges), changed.select(*FILE)), "affected")
    mine = edges.join(moved, FILE, "left_semi")
    lookups = edges.where("type in ('imports', 're_exports')")
    asked = mine.where("type not in ('imports', 're_exports')").unionByName(lookups)
    found = written(resolved(symbols, asked), "resolved")
    again = {
        "files": now, "symbols": symbols, "edges": edges,
        "resolved": found.withColumn("path", path_of(F.col("source"))), "callers": callers(symbols, mine, found).withColumn("path", path_of(F.col("caller_id"))),
    }
    entries = dict(manifest)
    touched = {"changed": changed, "moved": moved}
    lists = {k: sorted(r[0] for r in df.select(bucket_of(buckets).alias("b")).distinct().collect()) for k, df in touched.items()}  # numbers of buckets
    for t in TABLES:
        derived = t in ("resolved", "callers")
        own = lists["moved" if derived else "changed"]
        rows = again[t]
        if derived:  # other files of these buckets keep what was found
            rows = rows.select(*names(t)).unionByName(at[t].join(moved, FILE, "left_anti").select(*names(t)))
        there = _write(rows.where(bucket_of(buckets).isin(own)), root, t, generation, buckets)
        entries |= {(t, b): generation if b in there else -1 for b in own}
    _publish(spark, root, generation, entries)
    return generation
