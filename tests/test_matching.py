"""One-to-one matching in rounds against the rule taken literally."""

from __future__ import annotations

import random

import pytest

from corpusloom.operators import ranking


@pytest.mark.parametrize("round_rows", [1, 7, 500])
def test_matching_in_rounds(spark, round_rows):
    rng = random.Random(round_rows)
    kinds = [
        [(a, b, float(rng.randrange(5))) for a in range(25) for b in range(20) if rng.random() < 0.6],  # many ties, not all pairs
        [(a, b, float(b)) for a in range(30) for b in range(30)],  # all wish alike
        [(1, 1, 2.0), (1, 1, 1.0), (None, 1, 0.0), (2, None, 0.0), (2, 1, 0.5)],
        [],
    ]
    for pairs in kinds if round_rows > 1 else kinds[2:]:
        got = ranking.greedy_one_to_one(spark.createDataFrame(pairs, "a long, b long, dist double"), round_rows=round_rows)
        free, want = {b for _, b, _ in pairs}, []
        for a in sorted({a for a, b, _ in pairs if a is not None and b is not None}):
            open_ = [(d, b) for x, b, d in pairs if x == a and b is not None and b in free]
            if open_:
                d, b = min(open_)
                free.discard(b)
                want.append((a, b, d))
        assert sorted(map(tuple, got.select("a", "b", "dist").collect())) == want
