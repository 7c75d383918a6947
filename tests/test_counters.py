"""Nested counters against Python dictionaries."""

from __future__ import annotations

import random

from corpusloom.operators import counters


def test_counted_and_merged(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(["a", "b", None]), rng.choice(["x", "y", "z"])) for _ in range(300)]
    parts = [rows[:100], rows[100:250], rows[250:]]
    frames = [counters.counted(spark.createDataFrame(p, "k long, o string, i string"), ["k"], "o", "i") for p in parts]
    want = {}
    for k, o, i in rows:
        inner = want.setdefault(k, {}).setdefault(o or "", {})
        inner[i] = inner.get(i, 0) + 1
    got = counters.merged([*frames, frames[0].limit(0)], ["k"])
    assert {r.k: r.counters for r in got.collect()} == want
    shown = {r.k: r.s for r in got.select("k", counters.shown(got.counters).alias("s")).collect()}
    assert shown == {k: ";".join(f"{o}:" + ",".join(f"{i}={n}" for i, n in sorted(m.items())) for o, m in sorted(w.items())) for k, w in want.items()}


def test_odd_maps(spark):
    rows = [(1, '{"a": {"x": 1, "y": null}, "b": {}}'), (1, '{"a": {"x": 2}, "new": {"q": 5}}'), (2, "no json"), (3, None), (4, "{}")]
    df = spark.createDataFrame(rows, "k long, j string")
    got = counters.merged([df.select("k", counters.from_json(df.j).alias("counters"))], ["k"])
    assert {r.k: r.counters for r in got.collect()} == {1: {"a": {"x": 3, "y": 0}, "new": {"q": 5}}}
