import numpy as np
import pytest

from tessera.llm import neighbours

V = "vec_id long, embedding array<double>, qid int, cid string"


def brute(queries, base, k):
    """{(query, its vector): [(id, score)]} by all inner products; rows alike count once."""
    base = {(i, tuple(v)) for i, v in base}
    out = {}
    for q, v in {(i, tuple(v)) for i, v in queries}:
        far = sorted((-float((np.array(v) * np.array(x)).sum()), i) for i, x in base if len(x) == len(v) and (i, x) != (q, v))
        out[q, v] = [(i, -d) for d, i in far[:k]]
    return out


def search(spark, rows, k=20, every=20, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], V)
    got = {}
    for r in neighbours.nearest(df.where(df["vec_id"] % every == 0), df, k, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def recall(spark, rows, k=20, every=20, **more):
    got, want = search(spark, rows, k, every, **more), brute([r for r in rows if r[0] % every == 0], rows, k)
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for (q, _), near in want.items())
    assert all(len(got.get(q, [])) == len(near) for (q, _), near in want.items())
    scores = {(q, i): s for (q, _), near in want.items() for i, s in near}
    assert all(scores.get((q, i), s) == s for q, near in got.items() for i, s in near)
    return hits / sum(map(len, want.values()))


def plain(x):
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_the_rotation_keeps_lengths_and_the_transform_is_its_own_inverse():
    x = np.random.default_rng(1).normal(size=(7, 64))
    assert np.allclose(neighbours._hadamard(neighbours._hadamard(x)), x)
    assert np.allclose(np.linalg.norm(neighbours.rotated(x, 0, 0), axis=1), np.linalg.norm(x, axis=1))
    assert neighbours.rotated(x[:, :3], 1, 0).shape == (7, 4) and neighbours.rotated(x[:, :1], 1, 0).shape == (7, 2)


def test_chances_against_drawn_vectors():
    draw = np.random.default_rng(2)
    y = draw.normal(size=32)
    y /= np.linalg.norm(y)
    z = draw.normal(size=(200_000, 32))
    z -= (z @ y)[:, None] * y
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for c in (0.2, 0.5, 0.8):
        x = c * y + np.sqrt(1 - c * c) * z
        axis = np.abs(x).argmax(axis=1)
        seen = np.bincount(axis + 32 * (x[np.arange(len(x)), axis] < 0), minlength=64) / len(x)
        assert np.abs(seen - neighbours.chances(y, c)).max() < 0.02


def test_recall_on_the_table(spark):
    for sf in ("sf0.001", "sf0.1"):
        rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
        want = brute([r for r in rows if r[0] % 20 == 0], rows, 20)
        got = {}
        for r in neighbours.op12_neighbours(spark, f"/root/testdata/{sf}").collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert sum(len(got[q] & {i for i, _ in near}) for (q, _), near in want.items()) / sum(map(len, want.values())) >= 0.93


@pytest.mark.parametrize("functions", [1, 2])
def test_recall_in_clusters_and_with_unequal_norms(spark, functions):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16))
    x = centres[draw.integers(0, 12, 1500)] + 0.3 * draw.normal(size=(1500, 16))
    assert recall(spark, plain(x), 10, functions=functions) >= 0.9
    assert recall(spark, plain(x * np.exp(3 * draw.normal(size=(1500, 1)))), 10, functions=functions) >= 0.9


def test_a_third_of_all_rows_is_one_vector_and_a_third_is_near_it(spark, monkeypatch):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(1200, 8))
    x[::3] = x[0]
    x[1::3] = x[0] + 1e-3 * draw.normal(size=(400, 8))
    monkeypatch.setattr(neighbours, "BLOCK", 64)  # cells of many blocks, and of several shares
    monkeypatch.setattr(neighbours, "SHARE", 16)
    assert recall(spark, plain(x)) >= 0.95


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(0, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0]), (3, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (4, [-1.0, 0.0, -0.0]), (5, [0.0, 0.0, 2.5]), (4, [0.0, 0.5, 0.5]), (40, [3.0]), (60, [1.0, 2.0]), (7, [-4.0])]
    odd = [(80, None), (100, []), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 0.0]), (160, [1.0, nan, 0.0]), (180, [inf, 0.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    got = search(spark, fine + odd)
    assert got == {q: near for (q, _), near in brute([r for r in fine if r[0] % 20 == 0], fine, 20).items() if near}
    assert got[0][0] == (3, 1.0) and got[40] == [(7, -12.0)] and 60 not in got
    assert search(spark, []) == {} and search(spark, odd) == {}


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(200)]
    assert search(spark, rows, 5, every=50)[100] == [(i, 1.0) for i in (0, 2, 4, 6, 8)]
