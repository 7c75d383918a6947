"""Neighbour graphs against all pairs; layouts keep neighbourhoods better than two principal components."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import layout


def distances(x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return d


def trustworthiness(high, low, k):
    rank = np.argsort(np.argsort(distances(high), 1), 1) + 1
    near = np.argsort(distances(low), 1)[:, :k]
    n = len(high)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(0, np.take_along_axis(rank, near, 1) - k).sum()


@pytest.mark.parametrize("bucket_rows", [1000, 16])
def test_near_neighbours(spark, bucket_rows, monkeypatch):
    monkeypatch.setattr(layout, "BUCKET_ROWS", bucket_rows)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 6)) * 0.2 + rng.standard_normal((8, 6))[rng.integers(8, size=200)] * 3
    x[50:120] = x[50]  # a large group of copies
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(None, x[0].tolist()), (999, None)], "id long, v array<double>")
    rows = layout.near_neighbours(df, "id", "v", 5).collect()
    d = distances(x)
    by = {}
    for r in rows:
        assert r.a != r.b and r.dist == pytest.approx(d[r.a, r.b])
        by.setdefault(r.a, []).append(r)
    assert set(by) == set(range(200)) and all(sorted(r["rank"] for r in v) == list(range(1, len(v) + 1)) and len(v) <= 5 for v in by.values())
    near = sum(r.dist <= np.sort(d[a])[4] + 1e-9 for a, v in by.items() for r in v)
    assert near >= (1000 if bucket_rows == 1000 else 900)


def test_layout_keeps_neighbourhoods(spark):
    rng = np.random.default_rng(3)
    t = rng.random(240) * 3 * np.pi
    x = np.stack([np.cos(t), np.sin(t), t / 4, np.cos(2 * t), np.sin(3 * t), rng.standard_normal(240) * 0.02], 1)  # a curve that two components fold
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    got = {r.id: (r.x, r.y) for r in layout.layout(df, "id", "v", rounds=12).collect()}
    assert set(got) == set(range(240))
    low = np.array([got[k] for k in range(240)])
    centred = x - x.mean(0)
    pca = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert trustworthiness(x, low, 8) > trustworthiness(x, pca, 8) + 0.02


def test_layout_of_few_rows(spark):
    df = spark.createDataFrame([(5, [1.0]), (7, [2.0])], "id long, v array<double>")
    assert sorted(map(tuple, layout.layout(df, "id", "v").collect())) == [(5, 0.0, 0.0), (7, 1.0, 0.0)]
    assert layout.layout(df.limit(0), "id", "v").count() == 0 and layout.near_neighbours(df.where(F.lit(False)), "id", "v").count() == 0
