"""Rounds of a batch are one write; holes are made from bounded parts of a batch."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.functions import holes
from corpusloom.sources.shared import shared_path
from corpusloom.streaming import buffered


def test_all_rounds_of_a_batch_are_written_at_once(spark):
    table = shared_path(spark, "rounds")
    stream = buffered._streamed(spark.range(2000).withColumnRenamed("id", "k"), "rows")
    buffered.insert_rounds(stream, table, "k", shared_path(spark, "rounds-state"), 20)
    got = spark.read.parquet(table).groupBy("round").agg(F.count("*").alias("n"), F.min("k").alias("a")).collect()
    assert sorted((r["round"], r.n, r.a) for r in got) == [(k + 1, 20, 20 * k) for k in range(100)]
    assert len(spark.read.parquet(table).inputFiles()) <= 16  # a round a write left a hundred


def test_parts_of_a_batch_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, None if k == 3 else [rng.randrange(9) for _ in range(rng.randrange(60))]) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1)
    made = lambda: sorted(map(tuple, holes.pooled_holes(df, "doc_id", "ids", F.col("doc_id"), {"pad": -1, "start": -2, "end": -3, "hole": -4, "endhole": -5}).collect()))
    whole = made()
    monkeypatch.setattr(holes, "PART_IDS", 50)
    assert made() == whole and len(whole) == len(rows)
