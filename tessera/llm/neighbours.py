"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by fast Hadamard pseudo-rotations and files each
under the signed axis that its image is nearest to. A query probes several
cells of several tables; how many follows from the chance that a neighbour of
a given cosine lies in a cell, which its own image tells. The first round
probes a few cells; the score of the last neighbour found there bounds the
cosine that others must have to displace it, and the second round probes as
many cells more as bring the chance to find a neighbour of that cosine to
``TARGET``. Candidates are ranked by inner products of the original vectors.

Norms need not be equal: vectors are banded by norm, and the bound of a band
follows from its greatest norm. Equal vectors are one candidate with their
smallest ids. Cells are cut into blocks, and the queries of a cell into
shares, so that a task holds one bounded block, however many rows are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import saved, small_or_joined, table

#: Tables; the chance, over all tables, to probe the cell of a neighbour at the bound; cells of a table that the first round probes.
TABLES, TARGET, FIRST = 2, 0.95, 4
#: Vectors of one cell that a task compares at once, and queries that share one copy of them.
BLOCK, SHARE = 4096, 8192
#: Below so many vectors a cell, on the average, cells get no second function.
CELL = 256
KEY = ["dim", "band", "tab", "cell", "block", "share"]


# ---------------------------------------------------------------- hashing


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(unit: np.ndarray, tab: int, function: int) -> np.ndarray:
    """Rows padded to a power of two, their signs flipped and mixed three times; seeds follow from table and function."""
    n, d = unit.shape
    wide = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, wide))
    x[:, :d] = unit
    signs = np.random.default_rng([42, tab, function])
    for _ in range(3):
        x = _hadamard(x * signs.choice([-1.0, 1.0], wide))
    return x


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and their lengths."""
    most = np.abs(x).max(axis=1, keepdims=True)
    y = x / most
    length = np.sqrt((y * y).sum(axis=1, keepdims=True))
    return y / length, (most * length)[:, 0]


def cells_of(unit: np.ndarray, tab: int, functions: int) -> np.ndarray:
    """The cell of each row: its nearest signed axes, one for each function."""
    cell = np.zeros(len(unit), np.int64)
    for f in range(functions):
        y = rotated(unit, tab, f)
        axis = np.abs(y).argmax(axis=1)
        wide = y.shape[1]
        cell = cell * 2 * wide + axis + wide * (y[np.arange(len(y)), axis] < 0)
    return cell


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, by a rational approximation that errs by less than 1e-6."""
    s, x = np.sign(x), np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * (1 + s * (1 - series * np.exp(-x * x)))


def chances(y: np.ndarray, cosine: float, steps: int = 64) -> np.ndarray:
    """For each signed axis, the chance that it is nearest to the image of a vector at ``cosine`` from the query with image ``y``.

    Such an image is ``cosine * y`` plus a part in a random direction, whose
    coordinates are about normal; the chance that one coordinate is largest is
    an integral over its size of what all others stay below.
    """
    spread = np.sqrt(max(1e-9, 1 - cosine * cosine) / len(y))
    mean = np.abs(cosine * y)
    z = np.linspace(0.0, mean.max() + 6 * spread, steps)[:, None]
    below = np.log(np.maximum(1e-300, _normal((z - mean) / spread) - _normal((-z - mean) / spread)))
    others = below.sum(axis=1, keepdims=True) - below
    same = np.exp(others - 0.5 * ((z - mean) / spread) ** 2).sum(axis=0)
    against = np.exp(others - 0.5 * ((z + mean) / spread) ** 2).sum(axis=0)
    p = np.r_[np.where(cosine * y >= 0, same, against), np.where(cosine * y >= 0, against, same)]
    return p / p.sum()


def probing(images: list[np.ndarray], cosine: float, share: float) -> np.ndarray:
    """Cells of one table, likeliest first, that hold a vector at ``cosine`` with chance ``share``; ``images``: one for each function."""
    p = np.ones(1)
    for y in images:
        p = np.outer(p, chances(y, cosine)).ravel()
    order = np.argsort(-p, kind="stable")
    return order[: int(np.searchsorted(np.cumsum(p[order]), share)) + 1]


# ---------------------------------------------------------------- index


def _matrix(batch: pa.RecordBatch, name: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, rows as doubles) of a list column, for each length that occurs."""
    col = batch.column(name)
    sizes, flat = np.diff(col.offsets.to_numpy()), col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    if len(set(sizes.tolist())) == 1:
        return [(np.arange(len(sizes)), flat.reshape(len(sizes), -1))]
    return [(at, np.stack([flat[ends[i] - d : ends[i]] for i in at])) for d in np.unique(sizes).tolist() for at in [np.flatnonzero(sizes == d)]]


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vector) of rows that take part: with an id, and a vector that is neither null, empty nor zero, all of whose components are finite."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = dict(df.dtypes)[vector]
    v = v if kind in ("array<float>", "array<double>") else v.cast("array<double>")
    return df.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0).cast("float")).alias("vector"))


def _filed(functions: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            band, norm, dim, cells = np.zeros(n, np.int32), np.zeros(n), np.zeros(n, np.int32), np.zeros((n, tables), np.int64)
            for at, x in _matrix(batch, "vector") if n else []:
                unit, norm[at] = unit_rows(x)
                dim[at], band[at] = x.shape[1], np.floor(np.log2(norm[at]) + 0.5)
                for t in range(tables):
                    cells[at, t] = cells_of(unit, t, functions)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * tables + 1, tables), pa.int32()), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dim), pa.array(band), pa.array(norm), lists], names=[*batch.schema.names, "dim", "band", "norm", "cells"])

    return run


def index(base: DataFrame, k: int, tables: int = TABLES, functions: int | None = None) -> tuple[DataFrame, int]:
    """Classes of equal vectors, written, with their ``k`` smallest ids and their cell in each table; and the functions of a cell.

    A group of copies is cut to its smallest ids in the tasks that read it,
    before its rows are dealt. Where cells of one function would hold over
    ``CELL`` vectors squared over the axes, a second one is joined to it.
    """
    kind = dict(base.dtypes)["vector"]
    one = base.select("vector", "id").distinct()
    ranked = one.withColumn("at", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("at") <= k)
    classes = ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = saved(classes.select(F.monotonically_increasing_id().alias("cid"), "ids", "vector"), "classes")
    if functions is None:
        most = classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()  # a row for each length of vectors
        axes = lambda d: 2 << max(1, (d - 1).bit_length())
        functions = 1 + any(r["n"] > CELL * axes(r["d"]) ** 2 for r in most)
    filed = classes.mapInArrow(_filed(functions, tables), f"cid long, ids array<long>, vector {kind}, dim int, band int, norm double, cells array<long>")
    return saved(filed, "filed"), functions


# ---------------------------------------------------------------- probing and scanning


def _first(functions: int, tables: int):
    """Cells that the first round probes; (band, tab, cell) for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, out = batch.column("bands").to_pylist(), [[] for _ in range(batch.num_rows)]
            for at, x in _matrix(batch, "vector") if batch.num_rows else []:
                unit, _ = unit_rows(x)
                images = [[rotated(unit, t, f) for f in range(functions)] for t in range(tables)]
                for j, i in enumerate(at.tolist()):
                    cells = [probing([y[j] for y in images[t]], 0.5, 1.0)[:FIRST].tolist() for t in range(tables)]
                    out[i] = [(b["band"], t, c) for b in bands[i] for t in range(tables) for c in cells[t]]
            yield _probes(batch, out)

    return run


def _second(functions: int, tables: int, target: float):
    """Cells that the second round probes, without those of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = 1 - (1 - target) ** (1 / tables)
        for batch in batches:
            bands, bound, seen = (batch.column(c).to_pylist() for c in ("bands", "bound", "probes"))
            out = [[] for _ in range(batch.num_rows)]
            for at, x in _matrix(batch, "vector") if batch.num_rows else []:
                unit, norm = unit_rows(x)
                images = [[rotated(unit, t, f) for f in range(functions)] for t in range(tables)]
                cells = (2 * images[0][0].shape[1]) ** functions
                for j, i in enumerate(at.tolist()):
                    done = {(p["band"], p["tab"], p["cell"]) for p in seen[i]}
                    for b in bands[i]:
                        cosine = bound[i] / (norm[j] * b["norm"]) if bound[i] is not None else 0.0
                        if cosine > 1 + 1e-9:
                            continue  # no vector of this band comes up to the bound
                        if cosine <= 0:
                            found = [(b["band"], 0, c) for c in range(cells)]  # every vector is in some cell of the first table
                        else:
                            found = [(b["band"], t, c) for t in range(tables) for c in probing([y[j] for y in images[t]], min(cosine, 1.0), share).tolist()]
                        out[i] += [p for p in found if p not in done]
            yield _probes(batch, out)

    return run


_PROBE = pa.list_(pa.struct([("band", pa.int32()), ("tab", pa.int32()), ("cell", pa.int64())]))
PROBES = "probes array<struct<band int, tab int, cell long>>"


def _probes(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
    names = ["qid", "vector", "bound", "bands"]
    probes = pa.array([[dict(zip(("band", "tab", "cell"), p)) for p in r] for r in rows], _PROBE)
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), probes], names=[*names, "probes"])


def _scan(keep: int):
    """Rows of a task sorted by key, the vectors of a block before its queries: each query's ``keep`` best of the block, if they reach its bound."""

    def answers(ids, least, x, qids, bounds, q) -> pa.RecordBatch:
        near = q @ x.T
        low = bounds.copy()
        if len(ids) > keep:
            low = np.maximum(low, np.partition(near, len(ids) - keep, axis=1)[:, len(ids) - keep])
        slack = 1e-12 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
        a, b = np.nonzero(near >= (low - slack)[:, None])
        score = np.concatenate([(q[a[i : i + 65536]] * x[b[i : i + 65536]]).sum(axis=1) for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
        order = np.lexsort((least[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        a, b, score = a[rank < keep], b[rank < keep], score[rank < keep]
        own = np.concatenate([(q[a[i : i + 65536]] == x[b[i : i + 65536]]).all(axis=1) for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (qids[a], ids[b], least[b], own, score)], names=["qid", "cid", "least", "own", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in KEY], axis=1)
            isq = batch.column("query").to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (isq[1:] != isq[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if now is None or (keys[lo] != now).any():
                    now, held, block = keys[lo], [], None
                x = _matrix(part, "vector")[0][1]
                own, least, bound = (part.column(c).to_numpy() for c in ("rid", "least", "bound"))
                if not isq[lo]:
                    held.append((own, least, x))
                    continue
                if block is None:
                    block = tuple(np.concatenate(v) for v in zip(*held)) if held else ()
                step = max(1, (1 << 21) // max(1, len(block[0]) if block else 1))
                for i in range(0, len(own), step):
                    if block:
                        yield answers(*block, own[i : i + step], bound[i : i + step], x[i : i + step])

    return run


def scanned(filed: DataFrame, probes: DataFrame, keep: int) -> DataFrame:
    """(qid, cid, least, own, score): of each probed block a query's ``keep`` best at or above its bound.

    ``probes``: qid, vector, bound, probes. A cell's vectors are dealt into
    blocks and its queries into shares, as counts of both say.
    """
    cell = ["dim", "band", "tab", "cell"]
    base = filed.select(F.col("cid").alias("rid"), F.col("ids")[0].alias("least"), "vector", "dim", "band", F.posexplode("cells").alias("tab", "cell"))
    asked = probes.select(F.col("qid").alias("rid"), "vector", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"), F.size("vector").alias("dim"), F.inline("probes"))
    there = filed.select("dim", "band", F.posexplode("cells").alias("tab", "cell")).groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    wanted = probes.select(F.size("vector").alias("dim"), F.inline("probes")).groupBy(*cell).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    sizes = small_or_joined(there.join(wanted, cell), "cells")
    at = F.xxhash64("rid")
    base = base.join(sizes, cell).withColumn("block", F.pmod(at, F.col("blocks")).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    asked = asked.join(sizes, cell).withColumn("share", F.pmod(at, F.col("shares")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = [*KEY, "query", "rid", "least", "bound", "vector"]
    rows = base.select("*", F.lit(False).alias("query"), F.lit(0.0).alias("bound")).select(*cols)
    rows = rows.unionByName(asked.select("*", F.lit(True).alias("query"), F.lit(0).cast("long").alias("least")).select(*cols))
    spark = filed.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = rows.repartition(tasks, *KEY).sortWithinPartitions(*KEY, "query")
    return rows.mapInArrow(_scan(keep), "qid long, cid long, least long, own boolean, score double")


def best(found: DataFrame, keep: int) -> DataFrame:
    """Each query's ``keep`` best classes; one that several tables found counts once."""
    once = found.groupBy("qid", "cid", "least", "own").agg(F.max("score").alias("score"))
    return once.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "least"))).where(F.col("at") <= keep).drop("at")


def nearest(queries: DataFrame, base: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", tables: int = TABLES, target: float = TARGET, functions: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest rows of ``base`` found, by inner product; ties to the smaller id.

    A row takes part if it has an id and a vector that is neither null, empty
    nor zero and has finite components only; others give no result and are no
    candidates. Vectors of another length are no candidates of a query. A
    query's own row (the same id and vector) is left out, also if it occurs
    several times; rows alike count once, and an id with several vectors is a
    candidate with each. All candidates come back where there are at most
    ``k``. Extra columns are ignored; empty tables give no rows.
    """
    asked, rows = usable(queries, id_col, vector), usable(base, id_col, vector)
    if dict(asked.dtypes)["vector"] != dict(rows.dtypes)["vector"]:
        asked, rows = (df.withColumn("vector", F.col("vector").cast("array<double>")) for df in (asked, rows))
    kind, keep = dict(rows.dtypes)["vector"], k + 1
    filed, functions = index(rows, keep, tables, functions)
    # a band is a power of two of the norms, so there are at most some 2,100 for each length of vectors
    bands = filed.groupBy("dim", "band").agg(F.max("norm").alias("norm")).groupBy("dim").agg(F.collect_list(F.struct("band", "norm")).alias("bands"))
    asked = saved(asked.distinct(), "queries")
    distinct = asked.select("vector").distinct().select(F.monotonically_increasing_id().alias("qid"), "vector", F.lit(None).cast("double").alias("bound"), F.size("vector").alias("dim"))
    ready = distinct.join(small_or_joined(bands, "bands"), "dim")
    schema = f"qid long, vector {kind}, bound double, bands array<struct<band int, norm double>>, {PROBES}"
    one = saved(ready.mapInArrow(_first(functions, tables), schema), "first-probes")
    seen = saved(best(scanned(filed, one, keep), keep), "first-found")
    bound = seen.groupBy("qid").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") == keep).select("qid", "low")
    two = one.drop("bound").join(bound, "qid", "left").select("qid", "vector", F.col("low").alias("bound"), "bands", "probes")
    two = saved(two.mapInArrow(_second(functions, tables, target), schema), "second-probes")
    found = best(seen.unionByName(scanned(filed, two, keep)), keep)
    found = found.join(filed.select("cid", "ids"), "cid").groupBy("qid").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "ids", "own")).alias("classes"))
    each = F.flatten(F.transform("classes", lambda c: F.transform(c["ids"], lambda i: F.struct(c["far"].alias("far"), i.alias("id"), c["own"].alias("own")))))
    lists = found.select("qid", F.slice(F.array_sort(each), 1, keep).alias("near")).join(one.select("qid", "vector"), "qid").select("vector", "near")
    out = asked.join(lists, "vector").select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: ~(x["own"] & (x["id"] == F.col("id")))), 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every ``embeddings`` row whose id is divisible by 20; see ``nearest`` for nulls, ties, repeated rows and empty tables."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.where(F.col("vec_id") % 20 == 0), rows)
