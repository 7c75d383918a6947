"""Training rows that span documents, against numpy; texts to ids and back."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import tokens
from corpusloom.operators import ranking


@pytest.mark.parametrize(("length", "batch", "copies"), [(7, 3, 1), (1, 1, 1), (50, 2, 2), (1000, 1, 1)])
def test_rows_span_documents(spark, length, batch, copies):
    rng = random.Random(length)
    rows = [(k, rng.choice([None, [], [rng.randrange(99) for _ in range(rng.choice([1, 3, 20, 400]))]])) for k in range(60)]
    rng.shuffle(rows)
    whole = np.concatenate([np.array(x or [], int) for _, x in sorted(rows)])
    steps = len(whole) // (batch * length * copies)
    df = spark.createDataFrame(rows, "id long, ids array<int>").repartition(5)
    got = ranking.fixed_length_rows(df, [F.col("id")], "ids", length, batch, copies).collect()
    assert {r.row: r.ids for r in got} == dict(enumerate(whole[: steps * batch * length].reshape(-1, length).tolist()))


def test_too_little_for_a_step(spark):
    df = spark.createDataFrame([(1, [1, 2])], "id long, ids array<int>")
    with pytest.raises(ValueError, match="less than a step"):
        ranking.fixed_length_rows(df, [F.col("id")], "ids", 2, 2)
    with pytest.raises(ValueError, match="0 ids"):
        ranking.fixed_length_rows(df.limit(0), [F.col("id")], "ids", 2, 2)


def test_texts_to_ids_and_back(spark):
    texts = ["", None, "a\x00é日𝄞", "x" * 100_000]
    ids = tokens.text_ids(spark.createDataFrame([*enumerate(texts)], "id long, text string"), "id", "text")
    assert {r.id: r.ids for r in ids.collect()} == {k: [*map(ord, x or "")] for k, x in enumerate(texts)}
    back = tokens.ids_text(ids.withColumn("ids", F.concat(F.array(F.lit(-1)), "ids")), "id", skip=-1)
    assert {r.id: r.text for r in back.collect()} == {k: x or "" for k, x in enumerate(texts)}


@pytest.mark.parametrize("length", [1, 7, 512])
def test_rows_of_texts(spark, length):
    rng = random.Random(length)
    rows = [(k, rng.choice([None, "", "".join(rng.choice("ab é𝄞\n") for _ in range(rng.choice([1, 7, 14, 600])))])) for k in range(60)]
    rng.shuffle(rows)
    whole = [ord(c) for _, x in sorted(rows) for c in x or ""]
    n = len(whole) // (2 * length) * 2
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    got = ranking.fixed_length_rows(df, [F.col("id")], "text", length, 2).collect()
    assert len(got) == n and {r.row: r.ids for r in got} == {k: whole[k * length : (k + 1) * length] for k in range(n)}
