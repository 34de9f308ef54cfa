"""Readers of version-control and coverage texts, JVM-side: a frame of (key, text) rows in, relations out.

Each text is cut inside its row, so nothing is shuffled. Null and malformed
texts yield no rows.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.arrow import batches

#: The log format's commit mark, its fields, a numstat line, a diff's file and hunk headers.
SQLITE = b"SQLite format 3\0"
COMMIT, HEADER = "COMMIT:", r"^([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"
NUMSTAT, ADDED_FILE, HUNK = r"^(\d+|-)\t(\d+|-)\t(.+)$", r"^\+\+\+ (b/(.*)|/dev/null.*)$", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def _trimmed_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def log(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, commit, ts, author, message, files array) of a log printed as ``COMMIT:hash|epoch|author|subject`` and file lines."""
    blocks = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n\s*" + COMMIT)
    b = texts.select(*keys, F.posexplode(blocks).alias("block", "b")).where("block > 0")
    b = b.select(*keys, _trimmed_lines(F.col("b")).alias("l")).select(*keys, F.get("l", F.lit(0)).alias("h"), "l").where(F.col("h").rlike(HEADER))
    part = lambda i: F.regexp_extract("h", HEADER, i)
    ts = F.coalesce(F.regexp_extract("h", HEADER, 2).try_cast("bigint"), F.lit(0))
    return b.select(*keys, part(1).alias("commit"), ts.alias("ts"), part(3).alias("author"), part(4).alias("message"), F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))).alias("files"))


def log_files(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, commit, ts, author, message, path) of a ``--name-only`` log."""
    return log(texts, text, *keys).withColumn("path", F.explode("files")).drop("files")


def log_numstat(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, commit, ts, author, message, path, insertions, deletions) of a ``--numstat`` log; a binary file's dashes count as 0."""
    f = log(texts, text, *keys).withColumn("f", F.explode("files")).where(F.col("f").rlike(NUMSTAT))
    number = lambda i: F.when(F.regexp_extract("f", NUMSTAT, i) == "-", 0).otherwise(F.regexp_extract("f", NUMSTAT, i).try_cast("bigint"))
    return f.withColumn("path", F.regexp_extract("f", NUMSTAT, 3)).withColumn("insertions", number(1)).withColumn("deletions", number(2)).drop("f", "files")


def diff_ranges(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, path, start, end): new-side line ranges of a unified diff; pure deletions and deleted files have none."""
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike(ADDED_FILE) | x.startswith("@@ "))
    step = lambda acc, x: F.when(
        x.rlike(ADDED_FILE), F.struct(F.regexp_extract(x, ADDED_FILE, 2).alias("path"), acc["out"].alias("out"))
    ).otherwise(F.struct(acc["path"].alias("path"), F.concat(acc["out"], F.array(F.struct(acc["path"].alias("path"), x.alias("hunk")))).alias("out")))
    # the running file name is carried through one row's headers
    zero = F.struct(F.lit("").alias("path"), F.array().cast("array<struct<path:string,hunk:string>>").alias("out"))
    h = texts.select(*keys, F.explode(F.aggregate(lines, zero, step)["out"]).alias("h")).select(*keys, "h.*")
    start = F.regexp_extract("hunk", HUNK, 1).try_cast("bigint")
    count = F.coalesce(F.regexp_extract("hunk", HUNK, 2).try_cast("bigint"), F.lit(1))
    h = h.select(*keys, "path", start.alias("start"), count.alias("n")).where("path <> '' and start is not null and n > 0")
    return h.select(*keys, "path", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def diff_lines(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, path, line): the changed new-side lines."""
    return diff_ranges(texts, text, *keys).select(*keys, "path", F.explode(F.sequence("start", "end")).alias("line"))


def numbits(rows: DataFrame, bits: str, *keys: str) -> DataFrame:
    """(keys, line): the set bits of a bitmap, lines from 1, least significant bit first."""
    n = F.octet_length(F.col(bits))
    byte = F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))
    b = rows.select(*keys, bits, byte.alias("i")).withColumn("v", F.conv(F.hex(F.substring(F.col(bits), F.col("i"), F.lit(1))), 16, 10).cast("int"))
    b = b.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(7)))).where(F.expr("(shiftright(v, bit) & 1) = 1"))
    return b.select(*keys, ((F.col("i") - 1) * 8 + F.col("bit") + 1).alias("line")).distinct()


def coverage_xml(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, path, line): lines with hits in a Cobertura report; a class that comes twice is united."""
    c = texts.select(*keys, F.posexplode(F.split(F.col(text), r"<class\s")).alias("at", "c")).where("at > 0")
    c = c.select(*keys, F.regexp_extract("c", r'filename="([^"]*)"', 1).alias("path"), F.explode(F.regexp_extract_all("c", F.lit(r"<line\s[^>]*>"), F.lit(0))).alias("l"))
    number = lambda name: F.coalesce(F.regexp_extract("l", rf'\s{name}="(\d+)"', 1).try_cast("bigint"), F.lit(0))
    c = c.select(*keys, "path", number("number").alias("line"), number("hits").alias("hits"))
    return c.where("path <> '' and hits > 0 and line > 0").select(*keys, "path", "line").distinct()


def coverage_json(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, path, line): executed lines of a JSON report."""
    files = F.from_json(F.col(text), "files map<string, struct<executed_lines: array<bigint>>>")["files"]
    f = texts.select(*keys, F.explode(files).alias("path", "f"))
    return f.select(*keys, "path", F.explode("f.executed_lines").alias("line")).distinct()


def _line_bits(data: bytes) -> list[tuple[str, bytes]]:
    """(path, bitmap) rows of a database's bytes; none if its tables are others or broken."""
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(data)
        return con.execute("SELECT f.path, b.numbits FROM line_bits b JOIN file f ON f.id = b.file_id").fetchall()
    except sqlite3.Error:
        return []
    finally:
        con.close()


def coverage_sqlite(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """(key, path, line) of coverage databases read as bytes (``binaryFile``): every context's bitmaps united. Other bytes yield no rows."""

    schema = pa.schema([("report", pa.string()), ("path", pa.string()), ("numbits", pa.binary())])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            for row in part.to_pylist():
                found = _line_bits(row[content]) if (row[content] or b"").startswith(SQLITE) else []
                yield from ({"report": row[key], "path": p, "numbits": n} for p, n in found)

    bits = files.select(key, content).mapInArrow(lambda parts: batches(rows(parts), schema), "report string, path string, numbits binary")
    return numbits(bits, "numbits", "report", "path")
