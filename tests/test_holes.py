"""Holes: what is put back is the sequence, places are the given ones, and a plain version of the rule agrees."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import holes

IDS = {"pad": 0, "start": 1, "end": 2, "hole": 3, "endhole": 4}


def some_rows():
    rng = random.Random(8)
    rows = []
    for k in range(400):
        body = [rng.randrange(10, 30) for _ in range(rng.choice([0, 1, 2, 9, 40]))]
        seq = [1, *body, 2] if rng.random() < 0.5 else body
        seq = seq + [0] * rng.choice([0, 0, 5])
        where = None if k % 5 == 0 else [rng.randrange(-2, len(seq) + 3) for _ in range(rng.randint(0, 4))]
        rows.append((k, seq, where))
    return [*rows, (1000, None, [0]), (1001, [], None)]


@pytest.mark.parametrize("given", [False, True])
def test_holes(spark, given):
    rows = some_rows()
    df = spark.createDataFrame(rows, "k long, seq array<int>, places array<int>")
    make = lambda d: holes.pooled_holes(d, "k", "seq", F.xxhash64("k"), IDS, 0.3, 10, 4, "places" if given else None)
    got = {r.k: r for r in make(df.repartition(1)).collect()}
    assert got == {r.k: r for r in make(df.repartition(7)).collect()}
    kinds = set()
    for k, seq, where in rows:
        seq, r = seq or [], got[k]
        n = seq.index(0) if 0 in seq else len(seq)
        assert len(r.input) == len(seq) and len(r.starts) == len(r.positions) == len(r.labels) == len(r.lengths)
        back, at, spans = [], 0, []
        for start, place, label, length in zip(r.starts, r.positions, r.labels, r.lengths, strict=True):
            assert r.input[place] == 3 and label == (seq[start] if length else 4)
            back += [*r.input[at:place], *seq[start : start + length]]
            at = place + 1
            spans.append((start, start + length))
            assert not {1, 2, 0} & set(seq[start : start + length])
            assert not given or any(start <= w < max(start + length, start + 1) for w in where or [])
            kinds.add((length, label == 4))
        back += r.input[at:]
        assert [x for x in back if x] == seq[:n]
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
        target = min(10, max(1, round(n * 0.3)))
        hidden = sum(max(1, x) for x in r.lengths)
        if not given and len(r.input) > n + 10 and n > 2:
            assert hidden >= target
        assert hidden < target + 4 or not r.lengths
    assert {length for length, _ in kinds} == {0, 1, 2, 3, 4}


def test_a_sequence_without_room_for_an_empty_hole():
    for seed in range(50):
        out, found = holes.place_holes(np.array([9, 9, 9]), None, np.random.default_rng(seed), IDS, 0.5, 5, 2)
        assert len(out) == 3 and all(n for _, n in found[:1]) or not found
