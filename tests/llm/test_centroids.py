import hashlib
import math

import numpy as np
import pytest

from tessera.llm import centroids


def lloyd(rows, clusters=8, rounds=10, width=64, scale=1024):
    """Plain rounds over Python integers; {row number: (id, cluster, distance)} and the centroids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centre = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centre))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centre = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centre)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in kept), centre


@pytest.mark.parametrize("spread", [0.02, 1.0, 300.0])
def test_trees_cover_and_pairs_agree_with_all_distances(spread):
    draw = np.random.default_rng(5)
    x = np.unique(np.floor(1024 * (draw.normal(size=(5, 6))[draw.integers(0, 5, 300)] + spread * draw.normal(size=(300, 6)))).astype(np.int64), axis=0)
    tree = centroids.CoverTree(x)
    assert sorted(tree.order) == list(range(len(x))) and (tree.points == x[tree.order]).all()
    for i in range(len(tree.low)):
        below = tree.points[tree.low[i] : tree.high[i]]
        assert np.sqrt(((below - below[0]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-3
        kids = range(tree.first[i], tree.last[i])
        assert [(tree.low[k], tree.high[k]) for k in kids][:1] == ([(tree.low[i], tree.high[kids[0]])] if kids else []) and (not kids or tree.high[kids[-1]] == tree.high[i])
    c = [x[k].tolist() for k in (0, 50, 100, 50, 7)]  # two are equal: the smaller number takes all
    low, high, cluster = centroids.assigned(tree, *centroids._centre_tree(c))
    order = np.argsort(low)
    assert (low[order][1:] == high[order][:-1]).all() and low.min() == 0 and high.max() == len(x)
    label = np.repeat(cluster[order], (high - low)[order])
    far = ((tree.points[:, None] - np.array(c)[None]) ** 2).sum(axis=2)
    assert (label == far.argmin(axis=1)).all()


def test_pruning_leaves_few_pairs_in_clusters():
    """With far clusters whole subtrees are settled: far fewer ranges than points."""
    draw = np.random.default_rng(6)
    centre = np.floor(20_000 * draw.normal(size=(8, 64))).astype(np.int64)
    x = np.unique(centre[draw.integers(0, 8, 2000)] + np.floor(100 * draw.normal(size=(2000, 64))).astype(np.int64), axis=0)
    low, _, _ = centroids.assigned(centroids.CoverTree(x), *centroids._centre_tree(centre.tolist()))
    assert len(low) < len(x) / 20


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, v string")
    got, centre = centroids.clustered(df, **more)
    return sorted((str(r["id"]), r["cluster"], r["distance"]) for r in got.collect()), centre


def test_rounds_against_plain_lloyd(spark):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(6, 4))[draw.integers(0, 6, 400)] + 0.2 * draw.normal(size=(400, 4))
    x[::3] = x[0]  # a third of all rows are one vector
    x[1::7] *= 100
    rows = [(i // 2 if i % 5 == 0 else i, v.tolist()) for i, v in enumerate(x)]
    assert run(spark, rows, width=4) == lloyd(rows, width=4)


def test_blocks_of_a_partition(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(150, 3)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    monkeypatch.setattr(centroids, "BLOCK", 32)
    got, centre = centroids.clustered(df, width=3)
    assert (sorted((str(r["id"]), r["cluster"], r["distance"]) for r in got.collect()), centre) == lloyd(rows, width=3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0, 3.0])]
    fine = [(7, [0.0, -0.0]), (7, [0.0, 0.0]), (8, [-1.5, 2.25]), (None, [3.0, 1.0]), (9, [0.001, -0.001])]
    assert run(spark, odd + fine, width=2) == lloyd(odd + fine, width=2)
    assert run(spark, odd, width=2) == ([], []) and run(spark, [], width=2) == ([], [])
    assert run(spark, fine, clusters=2, width=2) == lloyd(fine, clusters=2, width=2)
    assert [r[0] for r in run(spark, [*fine, (10, [1e30, 0.0])], width=2)[0]] == [r[0] for r in run(spark, fine, width=2)[0]]
