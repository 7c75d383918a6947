"""Naive Bayes, folds and nearest rows against plain numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from corpusloom.operators import classify

FEATURES = ["x", "y", "z"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    rows = []
    for k in range(600):
        label = rng.choice(["a", "b", "c"])
        shift = {"a": 0, "b": 1.5, "c": -2}[label]
        rows.append((k, rng.choice(["g1", "g2", "g3"]), label, rng.gauss(shift, 1) + 1e6, rng.gauss(0, 1 + abs(shift)), 5.0))
    rows[3] = (3, "g1", "a", float("nan"), float("inf"), None)
    rows.append((601, "g4", "only", 1e6, 0.0, 5.0))
    return rows, spark.createDataFrame(rows, "id long, g string, label string, x double, y double, z double")


def clean(v):
    return 0.0 if v is None or math.isnan(v) or math.isinf(v) else v


def bayes(train, row):
    x = np.array([[clean(v) for v in r[3:]] for r in train])
    more = 1e-9 * x.var(0).max()
    best = None
    for label in sorted({r[2] for r in train}):
        own = x[[r[2] == label for r in train]]
        var = own.var(0) + more
        score = math.log(len(own) / len(x)) - 0.5 * float((np.log(2 * math.pi * var) + (np.array([clean(v) for v in row[3:]]) - own.mean(0)) ** 2 / var).sum())
        if best is None or score > best[0]:
            best = (score, label)
    return best[1]


def test_one_model(spark, data):
    rows, df = data
    moments = classify.class_moments(df, ["label"], FEATURES)
    model = classify.naive_bayes(moments, [], "label", FEATURES)
    got = {r.id: r.predicted for r in classify.predicted(df, model, [], FEATURES).collect()}
    assert got == {r[0]: bayes(rows, r) for r in rows}


@pytest.mark.parametrize("most", [100_000, 1])
def test_leave_one_group_out(spark, data, most, monkeypatch):
    monkeypatch.setattr(classify, "MAX_BROADCAST_MODELS", most)
    rows, df = data
    moments = classify.leave_one_out(classify.class_moments(df, ["g", "label"], FEATURES), "g", "label")
    got = {r.id: r.predicted for r in classify.predicted(df, classify.naive_bayes(moments, ["g"], "label", FEATURES), ["g"], FEATURES).collect()}
    want = {r[0]: bayes([o for o in rows if o[1] != r[1]], r) for r in rows}
    assert sum(got[k] != want[k] for k in want) == 0


def test_pairwise_and_merged(spark, data):
    rows, df = data
    cells = classify.class_moments(df, ["g", "label"], FEATURES)
    pairs = classify.naive_bayes(classify.pairwise(cells, "g", "label"), ["g", "test"], "label", FEATURES)
    assert {(r.g, r.test) for r in pairs.collect()} == {(a, b) for a in ("g1", "g2", "g3", "g4") for b in ("g1", "g2", "g3", "g4") if a != b}
    tested = df.withColumnRenamed("g", "test").join(pairs.select("g", "test"), "test")
    got = {(r.id, r.g): r.predicted for r in classify.predicted(tested, pairs, ["g", "test"], FEATURES).collect()}
    for (k, g), label in [*got.items()][::7]:
        assert label == bayes([o for o in rows if o[1] == g], next(r for r in rows if r[0] == k))
    one = {(r.label, r.feature): r for r in classify.merged(cells, ["label"]).collect()}
    for r in classify.class_moments(df, ["label"], FEATURES).collect():
        same = one[r.label, r.feature]
        assert same.n == r.n and same.mean == pytest.approx(r["mean"]) and same.m2 == pytest.approx(r.m2, rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("most", [10_000, 7])
def test_nearest_rows(spark, most, monkeypatch):
    monkeypatch.setattr(classify, "MAX_QUERIES", most)
    rng = random.Random(1)
    point = lambda: [float(rng.randrange(4)) for _ in range(3)]  # noqa: E731  many ties
    rows = [(k, rng.choice("ab"), point()) for k in range(300)] + [(None, "a", point()), (999, "b", None)]
    queries = [(k, point()) for k in range(40)] + [(None, point()), (77, None)]
    rng.shuffle(rows)
    r = spark.createDataFrame(rows, "id long, label string, v array<double>").repartition(5)
    q = spark.createDataFrame(queries, "q long, v array<double>")
    got = {x.q: (x.nearest_id, x.label, x.dist) for x in classify.nearest_rows(q, r, "v", "label", "q", "id").collect()}
    usable = [x for x in rows if x[0] is not None and x[2]]
    want = {}
    for k, v in queries:
        if k is not None and v:
            d, i, label = min((math.dist(v, x[2]), x[0], x[1]) for x in usable)
            want[k] = (i, label, pytest.approx(d))
    assert got == want
    assert classify.nearest_rows(q, r.limit(0), "v", "label", "q", "id").count() == 0
    assert classify.nearest_rows(q.limit(0), r, "v", "label", "q", "id").count() == 0


def test_report_writes_no_predictions(spark, sf):
    from pathlib import Path

    import __spark_entry__ as entry

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {*shared.iterdir()} if shared.exists() else set()
    assert entry.queries()["device_model_report"](spark, sf).count() == 21
    wrote = {x for x in shared.iterdir() if x not in before}
    assert {x.name.split("-")[0] for x in wrote} == {"measurements", "moments", "models"}
    held = spark.read.parquet(str(next(x for x in wrote if x.name.startswith("measurements"))))
    assert {*held.columns} == {"runtime_cpu", "runtime_gpu", "suite", "oracle", "atomic", "f1", "f2", "f3", "f4"}
