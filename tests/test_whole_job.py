"""Queries over all rows and whole values, against brute force."""

from __future__ import annotations

import random

from corpusloom.functions import tokens as tk
from corpusloom.operators import ranking
from corpusloom.plans import catalog


def test_every_hole_against_brute_force(spark):
    rows = [(1, list(range(20, 37))), (2, [7]), (3, []), (4, [5, 5]), (7, [1, 2, 3, 4, 5])]
    got = tk.all_holes(spark.createDataFrame(rows, "doc_id long, ids array<int>"), "ids", 9).collect()
    want = [(i, s, n, [*a[:s], 9, *a[s + n :]]) for i, a in rows for s in range(len(a)) for n in range(1, len(a) - s + 1)]
    assert sorted((r.doc_id, r.start, r["size"], r.ids) for r in got) == sorted(want)


def test_every_hole_takes_all_documents(spark, sf):
    got = catalog.queries()["every_hole"](spark, sf)
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_masked_instances_are_whole_texts(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = catalog.queries()["masked_instances"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = list(r.input)
        for at, label in zip(r.positions, r.labels, strict=True):
            ids[at] = label
        assert "".join(map(chr, ids)) == texts[r.doc_id]
        assert len(r.positions) == (max(1, int(0.15 * len(ids))) if ids else 0)


def test_whole_texts_are_wrapped_decoded_and_positioned(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    q = catalog.queries()
    wrapped = {r.doc_id: r for r in q["text_wrap_and_pad"](spark, sf).collect()}
    for i, text in texts.items():
        want = [-2, *map(ord, text), -3]
        assert wrapped[i].n == len(want)
        assert [int(x) for x in wrapped[i].ids.split(",")] == want + [0] * (512 - len(want))
    assert max(r.n for r in wrapped.values()) > 512
    assert {r.doc_id: r.text for r in q["text_decoded_ids"](spark, sf).collect()} == texts
    places = q["text_token_positions"](spark, sf).collect()
    assert len(places) == sum(len(x.split(" ")) for x in texts.values())
    assert all(texts[r.doc_id][r.first_char :].startswith(r.word) and texts[r.doc_id][: r.first_char].count(" ") == r.token for r in places)


def test_grids_study_sets_and_searches_take_all_rows(spark, sf):
    q, table = catalog.queries(), lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    assert q["whole_parameter_grid"](spark, sf).count() == 55 * table("part").count()
    assert q["whole_study_set"](spark, sf).count() == table("documents").select("text").distinct().count()
    targets = table("embeddings").where("vec_id % 20 = 0").count()
    assert targets > 1
    for name in ("growing_k_average_score", "growing_min_score", "growing_top_k_per_target"):
        assert q[name](spark, sf).select("target_id").distinct().count() == targets


def test_greedy_one_to_one_in_rounds(spark):
    rng = random.Random(3)
    rows = [(a, b, float(rng.randrange(6))) for a in range(25) for b in range(20) if rng.random() < 0.7]
    got = ranking.greedy_one_to_one(spark.createDataFrame(rows, "a long, b long, dist double"))
    taken, want = set(), []
    for a in range(25):
        free = [(d, b) for x, b, d in rows if x == a and b not in taken]
        if free:
            taken.add(min(free)[1])
            want.append((a, min(free)[1], min(free)[0]))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()


def test_vectors_are_compared_and_scaled_whole(spark, sf):
    q, v = catalog.queries(), spark.read.parquet(f"{sf}/embeddings.parquet")
    rows, dim = v.count(), len(v.first().embedding)
    got = q["whole_vector_dedup"](spark, sf).collect()
    key = {r.vec_id: tuple(round(float(x), 1) + 0.0 for x in r.embedding) for r in v.collect()}
    assert len(got) == rows and len({r.first_id for r in got}) == len(set(key.values()))
    assert q["whole_z_scores"](spark, sf).count() == rows * dim
    assert q["whole_max_normalized"](spark, sf).select("k").distinct().count() == dim
