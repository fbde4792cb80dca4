"""Nearest vectors by blocks against plain comparison of all pairs."""

import numpy as np
import pytest

from textmill.operators import nearest
from textmill.operators import retrieve as rt


def clustered(n, dims=16, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, dims))
    return (middles[rng.integers(0, 12, n)] + rng.normal(scale=0.05, size=(n, dims))) * scale


@pytest.mark.parametrize(("scale", "k", "pivots", "bits"), [(1.0, 5, 24, 4), (1000.0, 3, 20, 5), (1.0, 500, 8, 4)])
def test_top_k_by_blocks(spark, monkeypatch, scale, k, pivots, bits):
    monkeypatch.setattr(nearest, "BLOCK_BITS", bits)
    monkeypatch.setattr(nearest, "QUESTIONS", 7)
    x = clustered(400, scale=scale)
    q = x[:30] + np.random.default_rng(2).normal(scale=0.05 * scale, size=(30, 16))
    x[10:14] = x[9]  # ties
    index = spark.createDataFrame([(f"c{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("empty", [])], "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(30, x[9].tolist()), (31, None), (32, [])], "query_id int, query array<double>")
    blocked = nearest.BlockedIndex(index, pivots)
    near, pairs = nearest.nearest_pairs(blocked, queries, k)
    got = {}
    for r in near.collect():
        got.setdefault(r.query_id, []).append((round(r.score, 6), r.chunk_id))
    for i, v in enumerate([*q, x[9]]):
        want = sorted((round(float(((v - y) ** 2).sum()), 6), f"c{j:03d}") for j, y in enumerate(x))[:k]
        found = sorted(got[i])[:k]
        assert [c for _, c in found] == [c for _, c in want]
        assert np.allclose([d for d, _ in found], [d for d, _ in want], atol=1e-6 * scale**2)
    assert set(got) == set(range(31))
    assert nearest.searched_share(blocked, queries, k) < (0.5 if k < 50 else 1.01)


def test_top_k_of_little(spark):
    index = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 0.0])], "chunk_id int, embedding array<float>")
    queries = spark.createDataFrame([(7, [0.0, 0.2])], "query_id long, query array<float>")
    assert [(r.chunk_id, r.rank) for r in rt.top_k(index, queries, 5).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert rt.top_k(index.limit(0), queries, 5).count() == 0 and rt.top_k(index, queries.limit(0), 5).count() == 0


@pytest.mark.parametrize("exclude", [False, True])
def test_best_match_by_blocks(spark, exclude):
    x = clustered(200, seed=3)
    x[5] = x[50] = x[60] = 0.0
    x[20] = 3 * x[19]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    index = spark.createDataFrame(rows, "chunk_id int, embedding array<double>")
    away = [(900, (-x.sum(axis=0)).tolist()), (901, [0.0] * 16), (902, None)]
    queries = spark.createDataFrame(rows[::3] + [rows[5], rows[19], *away], "query_id int, query array<double>").distinct()
    got = {r.query_id: (r.chunk_id, r.score) for r in rt.best_match(index, queries, exclude_self=exclude).collect()}

    def cosine(a, b):
        na, nb = np.sqrt(a @ a), np.sqrt(b @ b)
        return 0.0 if na == 0 or nb == 0 else round(float(a @ b / (na * nb)), 6)

    for i, v in [*rows[::3], rows[5], rows[19], *away[:2]]:
        want = min((-cosine(np.array(v), y), j) for j, y in enumerate(x) if not (exclude and i == j))
        assert got[i][0] == want[1] and abs(got[i][1] + want[0]) < 2e-6
    assert got[902] == (None, None)
