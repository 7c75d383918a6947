"""Nearest samples by blocks of vectors, against brute force and plans without a row for each pair."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import nearest, ranking
from corpusloom.plans import catalog

TARGETS, SAMPLES = "target_id long, target array<double>", "vec_id long, features array<double>"


def _rows(n, seed, dim=3):
    """Small whole components, so that many distances are equal."""
    rng = random.Random(seed)
    return [(i, [float(rng.randrange(3)) for _ in range(dim)]) for i in range(n)]


def _far(t, s, metric="feature"):
    return math.sqrt(sum(abs(a * a - b * b) if metric == "feature" else (a - b) * (a - b) for a, b in zip(t, s, strict=True)))


@pytest.mark.parametrize(("metric", "k"), [("feature", 1), ("feature", 4), ("euclid", 3)])
def test_nearest_by_key_with_ties_and_copies(spark, monkeypatch, metric, k):
    monkeypatch.setattr(nearest, "LEAST_TASKS", 3)
    monkeypatch.setattr(nearest, "MAX_BROADCAST_TARGETS", 20)
    t, s = _rows(45, 1), _rows(160, 2)
    near = nearest.nearest(spark.createDataFrame(t, TARGETS), spark.createDataFrame(s, SAMPLES), k, metric, F.col("vec_id") % 3)
    got = ranking.top_k(near, ["target_id", "key"], ["dist", "vec_id"], k).select("target_id", "key", "vec_id", "dist").collect()
    want = [(i, key, j, d) for i, x in t for key in range(3) for d, j in sorted((_far(x, y, metric), j) for j, y in s if j % 3 == key)[:k]]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_nearest_keeps_what_rounding_makes_equal(spark):
    t, s = [(1, [0.0])], [(9, [0.30001]), (8, [0.30002]), (7, [0.30004]), (6, [0.30049]), (5, [0.4])]
    near = nearest.nearest(spark.createDataFrame(t, TARGETS), spark.createDataFrame(s, SAMPLES), 1, "euclid", digits=3)
    got = near.agg(F.min(F.struct(F.round("dist", 3).alias("dist"), "vec_id")).alias("m")).first().m
    assert (got.dist, got.vec_id) == (0.3, 6)


def test_nearest_with_zero_apart(spark):
    t, s = [(1, [1.0, 2.0])], [(2, [1.0, 2.0]), (3, [2.0, 2.0]), (4, [1.0, -2.0]), (5, [9.0, 9.0])]
    near = nearest.nearest(spark.createDataFrame(t, TARGETS), spark.createDataFrame(s, SAMPLES), 1, zero_apart=True)
    first = lambda rows: tuple(rows.agg(F.min(F.struct("dist", "vec_id")).alias("m")).first().m)
    assert first(near.where("dist = 0")) == (0.0, 2)
    assert first(near.where("dist > 0")) == (math.sqrt(3), 3)


def test_vectors_without_a_distance(spark):
    t = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [])]
    s = [(5, [1.0, 2.0]), (6, [1.0]), (7, None), (8, [1.0, None]), (9, [1.0, float("nan")]), (10, [])]
    targets, samples = spark.createDataFrame(t, TARGETS), spark.createDataFrame(s, SAMPLES)
    near = {(r.target_id, r.vec_id) for r in nearest.nearest(targets, samples, 9).collect()}
    assert near == {(1, 5), (1, 9), (3, 6), (4, 10)}
    pairs = nearest.pair_distances(targets, samples).collect()
    assert len(pairs) == len(t) * len(s)
    assert {(r.target_id, r.vec_id) for r in pairs if r.dist is not None} == near
    assert nearest.nearest(targets.limit(0), samples, 1).count() == 0
    assert nearest.nearest(targets, samples.limit(0), 1).count() == 0


@pytest.mark.parametrize("most_targets", [20_000, 20])
def test_more_pairs_are_more_tasks_not_larger_ones(spark, monkeypatch, most_targets):
    monkeypatch.setattr(nearest, "TASK_PAIRS", 400, raising=False)
    monkeypatch.setattr(nearest, "MAX_BROADCAST_TARGETS", most_targets)
    t, s = _rows(40, 5), _rows(2000, 6)
    found = nearest.pair_distances(spark.createDataFrame(t, TARGETS), spark.createDataFrame(s, SAMPLES)).withColumn("task", F.spark_partition_id())
    assert max(r["count"] for r in found.groupBy("task").count().collect()) < 1000
    got = [(r.target_id, r.vec_id, r.dist, r.euclid) for r in found.collect()]
    assert sorted(got) == sorted((i, j, _far(x, y), _far(x, y, "euclid")) for i, x in t for j, y in s)


@pytest.mark.parametrize(("rows", "k"), [(64, 2), (8, 8), (1, 1)])
def test_one_to_one_with_copies(spark, monkeypatch, rows, k):
    monkeypatch.setattr(nearest, "LEAST_TASKS", 2)
    n = 6 if rows == 1 else 30
    t, s = [(i, [1.0, 1.0]) for i in range(n // 2)] + [(i + n, x) for i, x in _rows(n - n // 2, 3, 2)], _rows(n - 3, 4, 2)
    got = nearest.one_to_one(spark.createDataFrame(t, TARGETS), spark.createDataFrame(s, SAMPLES), 6, rows, k).collect()
    taken, want = set(), []
    for i, x in sorted(t):
        free = [(round(_far(x, y), 6), j) for j, y in s if j not in taken]
        if free:
            taken.add(min(free)[1])
            want.append((i, min(free)[1], min(free)[0]))
    assert sorted(tuple(r) for r in got) == want


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["growing_best_so_far", "growing_beam_report", "growing_far_targets", "growing_feature_distance", "growing_k_average_score", "growing_min_score", "growing_mutation_gain", "growing_top_k_per_target", "growing_top_k_that_ran", "whole_feed_queue", "feed_queue", "human_likeness_set"])
def test_pairs_are_blocks_not_rows(spark, sf, name):
    """A join of targets and samples meets packed blocks only."""
    plan = _plan(catalog.queries()[name](spark, sf))
    assert "t_cells" in plan and "zip_with" not in plan
