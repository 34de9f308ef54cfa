"""Centroid clustering by dual-tree Lloyd rounds over integer vectors.

Vectors are cut into blocks, and a cover tree is built over the distinct
vectors of each block once; blocks and trees are written as one table. A round
builds a cover tree over the centroids and walks both trees together, all node
pairs of a level at once: a pair whose lower bound on the distance exceeds the
upper bound of the node's nearest centroid is dropped, a node with one centroid
left gives its whole sum to it, and leaf pairs are compared exactly, in
integers. Sums of the blocks are added by Spark; between rounds the driver
holds the centroids and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import saved, table

#: Fixed values of the query: components, their scale, centroids, rounds.
WIDTH, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10
#: Vectors of a block, over which one tree is built.
BLOCK = 2048
#: Components beyond this have squared distances that a long doesn't hold.
LARGEST = 1 << 27
#: Share of the largest length by which bounds in doubles may err.
SLACK = 1e-7


# ---------------------------------------------------------------- cover trees


class CoverTree:
    """A cover tree over distinct integer ``points``, stored in leaf order.

    ``order`` gives each stored point's place in the input. A node stands for
    the points ``low .. high - 1``; its centre is the one at ``low``, its
    radius the greatest distance from there, its children the nodes
    ``first .. last - 1``. Children of a node within 2**l are centres more
    than 2**(l-1) apart, each with what lies within 2**(l-1) of it.
    """

    def __init__(self, points: np.ndarray):
        n = len(points)
        x = points.astype(np.float64)
        square = (x * x).sum(axis=1)
        far = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))
        nodes, sets = [], [np.arange(n)]  # a set begins with its centre
        at = 0
        while at < len(sets):
            own = sets[at]
            radius = far[own[0], own].max() if len(own) > 1 else 0.0
            first = len(sets)
            if len(own) > 1:
                reach = 2.0 ** (np.ceil(np.log2(max(radius, 0.5))) - 1)
                rest = own
                while len(rest):
                    near = far[rest[0], rest] <= reach
                    near[0] = True
                    if near.all() and len(rest) == len(own):  # all distances round to less than the reach: one child a point
                        sets += [own[i : i + 1] for i in range(len(own))]
                        break
                    sets.append(rest[near])
                    rest = rest[~near]
            nodes.append((radius, first, len(sets)))
            at += 1
        self.radius = np.array([r for r, _, _ in nodes])
        self.first, self.last = (np.array([v[k] for v in nodes], np.int64) for k in (1, 2))
        self.low = np.zeros(len(nodes), np.int64)
        sizes = np.array([len(s) for s in sets], np.int64)
        for i in range(len(nodes)):  # parents come before their children
            a, b = self.first[i], self.last[i]
            if b > a:
                self.low[a:b] = self.low[i] + np.cumsum(sizes[a:b]) - sizes[a:b]
        self.high = self.low + sizes
        self.order = np.zeros(n, np.int64)
        for s, place in zip(sets, self.low.tolist()):
            if len(s) == 1:
                self.order[place] = s[0]
        self.points = points[self.order]


def _opened(first: np.ndarray, last: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many nodes each of ``at`` opens into, itself if it has no children, and the first of them."""
    leaf = last[at] == first[at]
    return np.where(leaf, 1, last[at] - first[at]), np.where(leaf, at, first[at])


def assigned(tree: CoverTree, centres: CoverTree, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, cluster): ranges of the tree's points and the cluster of each; ``number``: of the centres' points."""
    x, c = tree.points, centres.points
    slack = SLACK * (1 + max(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1).max()) for v in (x, c)))
    n, m = np.zeros(1, np.int64), np.zeros(1, np.int64)
    done = []
    while len(n):
        apart = (x[tree.low[n]] - c[centres.low[m]]).astype(np.float64)
        d = np.sqrt((apart * apart).sum(axis=1))
        start = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
        # a node's centre is a point, so nothing below n is farther from its nearest centroid than this
        most = np.repeat(np.minimum.reduceat(d + tree.radius[n], start), np.diff(np.r_[start, len(n)]))
        keep = d - tree.radius[n] - centres.radius[m] <= most + slack
        n, m = n[keep], m[keep]
        start = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
        size = np.diff(np.r_[start, len(n)])
        single = centres.first[m] == centres.last[m]
        settled = (size == 1) & single[start]
        exact = ~settled & (tree.first[n[start]] == tree.last[n[start]]) & np.logical_and.reduceat(single, start)
        done.append(np.stack([tree.low[n[start]], tree.high[n[start]], number[centres.low[m[start]]]])[:, settled])
        if exact.any():
            at = np.repeat(exact, size)
            p, q = n[at], m[at]
            apart = x[tree.low[p]] - c[centres.low[q]]
            order = np.lexsort((number[centres.low[q]], (apart * apart).sum(axis=1), p))
            p, q = p[order], q[order]
            best = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            done.append(np.stack([tree.low[p[best]], tree.high[p[best]], number[centres.low[q[best]]]]))
        open_ = np.repeat(~(settled | exact), size)
        n, m = n[open_], m[open_]
        kn, fn = _opened(tree.first, tree.last, n)
        km, fm = _opened(centres.first, centres.last, m)
        pair = np.repeat(np.arange(len(n)), kn * km)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(kn * km) - kn * km, kn * km)
        n, m = fn[pair] + at // km[pair], fm[pair] + at % km[pair]
        order = np.argsort(n, kind="stable")
        n, m = n[order], m[order]
    return tuple(np.concatenate(done, axis=1))


# ---------------------------------------------------------------- blocks

_BLOCKS = "ids array<long>, place array<int>, weight array<long>, points binary, radius binary, nodes binary"


def integers(vector: str, width: int, scale: int) -> Column:
    """Components as floor(scale * x), null where the vector is not kept."""
    v = F.col(vector)
    fine = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST))
    return F.when(fine, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of a partition: ids, where their vectors stand in leaf order, and the tree over the distinct vectors."""

    def block(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        distinct, inverse, weight = np.unique(x, axis=0, return_inverse=True, return_counts=True)
        tree = CoverTree(distinct.astype(np.int64))
        place = np.argsort(tree.order)[inverse.ravel()]
        one = lambda v, t: pa.array([v], t)
        nodes = np.stack([tree.first, tree.last, tree.low, tree.high]).astype("<i4").tobytes()
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(place.tolist(), pa.list_(pa.int32())), one(weight[tree.order].tolist(), pa.list_(pa.int64())),
                one(tree.points.astype("<i4").tobytes(), pa.binary()), one(tree.radius.tobytes(), pa.binary()), one(nodes, pa.binary()),
            ], names=["ids", "place", "weight", "points", "radius", "nodes"],
        )

    ids, xs, held = [], [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            ids.append(part.column("id"))
            xs.append(part.column("v").flatten().to_numpy().reshape(part.num_rows, -1))
            held += part.num_rows
            if held >= BLOCK:
                every, x = pa.concat_arrays(ids), np.concatenate(xs)
                yield block(every[:BLOCK], x[:BLOCK])
                ids, xs, held = [every[BLOCK:]], [x[BLOCK:]], held - BLOCK
    if held:
        yield block(pa.concat_arrays(ids), np.concatenate(xs))


class _Stored(CoverTree):
    """A tree read back from its row."""

    def __init__(self, points: bytes, radius: bytes, nodes: bytes):
        self.radius = np.frombuffer(radius)
        self.first, self.last, self.low, self.high = np.frombuffer(nodes, "<i4").astype(np.int64).reshape(4, -1)
        self.points = np.frombuffer(points, "<i4").astype(np.int64).reshape(self.high[0], -1)


def _centre_tree(centroids: list[list[int]]) -> tuple[CoverTree, np.ndarray]:
    """A tree over the distinct centroids and the smallest number of each."""
    points, first = np.unique(np.array(centroids, np.int64), axis=0, return_index=True)
    tree = CoverTree(points)
    return tree, first[tree.order]


def _stored(batch: pa.RecordBatch) -> Iterator[tuple[int, _Stored]]:
    for i in range(batch.num_rows):
        yield i, _Stored(*(batch.column(c)[i].as_py() for c in ("points", "radius", "nodes")))


def _summed(centroids: list[list[int]]):
    """Of a partition's blocks: for each cluster how many vectors it has, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, number = _centre_tree(centroids)
        total = np.zeros((len(centroids), 1 + len(centroids[0])), np.int64)
        for batch in batches:
            for i, tree in _stored(batch):
                weight = batch.column("weight")[i].values.to_numpy()
                sums = np.zeros((len(weight) + 1, total.shape[1]), np.int64)
                np.cumsum(np.concatenate([weight[:, None], weight[:, None] * tree.points], axis=1), axis=0, out=sums[1:])
                low, high, cluster = assigned(tree, centres, number)
                np.add.at(total, cluster, sums[high] - sums[low])
        at = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].tolist(), pa.list_(pa.int64()))], names=["cluster", "sums"])

    return run


def _labelled(centroids: list[list[int]]):
    """Every vector's cluster and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, number = _centre_tree(centroids)
        c = np.array(centroids, np.int64)
        for batch in batches:
            for i, tree in _stored(batch):
                low, high, cluster = assigned(tree, centres, number)
                order = np.argsort(low)
                label = np.repeat(cluster[order], (high - low)[order])
                far = ((tree.points - c[label]) ** 2).sum(axis=1)
                place = batch.column("place")[i].values.to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(label[place].astype(np.int32)), pa.array(far[place])], names=["id", "cluster", "distance"])

    return run


# ---------------------------------------------------------------- rounds


def clustered(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE, seed: str = "3:") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every kept row of ``df``, written, and the final centroids.

    Kept are vectors of ``width`` components, none null or not finite, whose
    scaled integers stay below 2**27 in size, beyond which a squared distance
    is no long. Rows alike are rows of their own. First centroids are those
    whose ids have the smallest digests; equal digests go by the vector, null
    ids last. Fewer rows than clusters make fewer clusters; an empty table
    gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), integers(vector, width, scale).alias("v")).where("v is not null")
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = rows.select(digest.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(clusters)
    centroids = [list(r["v"]) for r in first.orderBy(F.asc_nulls_last("h"), "v").collect()]
    if not centroids:
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    blocks = saved(rows.mapInArrow(_built, _BLOCKS), "blocks")
    for _ in range(rounds):
        parts = blocks.mapInArrow(_summed(centroids), "cluster int, sums array<long>")
        each = parts.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(19,0)")).alias("x"))
        sums: dict[int, dict[int, int]] = {}
        for r in each.collect():  # clusters times components
            sums.setdefault(r["cluster"], {})[r["at"]] = int(r["x"])
        centroids = [[s[j] // s[0] for j in range(1, width + 1)] if (s := sums.get(k)) else old for k, old in enumerate(centroids)]
    return saved(blocks.mapInArrow(_labelled(centroids), "id long, cluster int, distance long"), "labelled"), centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all ``embeddings`` after ten rounds; see ``clustered`` for nulls, ties, repeated rows and empty tables."""
    rows, centroids = clustered(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumnRenamed("id", "vec_id")
    # one row for each of the eight centroids
    digests = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()
    per = {r["cluster"]: int(r["s"]) for r in per}
    known = spark.createDataFrame([(k, per.get(k, 0), sum(per.values()), h) for k, h in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _twin() -> str:
    """DuckDB SQL of ``op13_centroids``, its rounds written out."""
    out = [
        f"""kept AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), comp AS (SELECT vec_id, unnest(range({WIDTH})) AS j, unnest(v) AS x FROM kept)""",
        f"""c0 AS (
          SELECT c, unnest(range({WIDTH})) AS j, unnest(v) AS y FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM kept) WHERE c < {CLUSTERS}
        )""",
    ]
    for k in range(ROUNDS + 1):
        out.append(f"""a{k} AS MATERIALIZED (
          SELECT vec_id, min({{'d': d, 'c': c}}) AS m FROM (SELECT vec_id, c, sum((x - y) * (x - y)) AS d FROM comp JOIN c{k} USING (j) GROUP BY 1, 2) GROUP BY 1
        )""")
        if k < ROUNDS:
            out.append(f"""c{k + 1} AS MATERIALIZED (
              SELECT c, j, coalesce(((s - ((s % n + n) % n)) // n)::BIGINT, y) AS y FROM c{k}
              LEFT JOIN (SELECT m.c AS c, j, sum(x) AS s, count(*) AS n FROM a{k} JOIN comp USING (vec_id) GROUP BY 1, 2) USING (c, j)
            )""")
    return f"""
        WITH {', '.join(out)}, h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY 1)
        SELECT vec_id, m.c::INT AS cluster, m.d::BIGINT AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{ROUNDS} JOIN h ON h.c = m.c
    """


TWIN = _twin()
