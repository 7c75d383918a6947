"""Feed queues and the mutation beam against plain Python."""

from __future__ import annotations

import math

from corpusloom.operators import search
from corpusloom.plans import catalog


def beam_by_force(targets, n, width, depth):
    out = []
    for target in targets:
        beam, generation = [(1000, target)], 0
        for g in range(1, depth + 1):
            best = {v: s for s, v in beam}
            for _, v in beam:
                for k in (1, 2, 5):
                    child = (v * 3 + k) % n
                    best[child] = min(best.get(child, math.inf), (child * 31 + target * 7) % 97)
            new = sorted((s, v) for v, s in best.items())[:width]
            if not (sum(s for s, _ in new) < sum(s for s, _ in beam) or len(new) > len(beam)):
                break
            beam, generation = new, g
        out += [(target, v, s, generation) for s, v in beam]
    return sorted(out)


def test_mutation_beam_against_plain_python(spark, sf):
    ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    got = catalog.queries()["mutation_beam"](spark, sf).collect()
    assert sorted((r.target, r.node, r.score, r.generation) for r in got) == beam_by_force([i for i in ids if i % 20 == 0], len(ids), 3, 8)
    assert len({r.generation for r in got}) > 1


def test_feed_queue_of_targets_without_samples(spark):
    scored = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.25), (1, 9, 0.5), (1, None, 0.0)], "target long, node long, score double")
    got = search.feed_queue(scored, spark.createDataFrame([(1,), (2,), (2,)], "target long"), 2).collect()
    assert sorted((r.target, r.node or -1, r.score) for r in got) == [(1, 7, 0.5), (1, 8, 0.25), (2, -1, math.inf)]


def test_closure_of_a_graph_with_cycles(spark):
    from corpusloom.sources.shared import saver

    edges = [(1, 2), (2, 3), (3, 2), (4, 4), (5, None), (None, 1), (6, 1), (1, 2)]
    roots = spark.createDataFrame([(k,) for k in (1, 3, 4, 5, 6, 7)], "root long")
    got = search.closure(spark.createDataFrame(edges, "a long, b long"), roots, saver(spark, "closure")).collect()
    want = {1: {2, 3}, 3: {2, 3}, 4: {4}, 6: {1, 2, 3}}
    assert sorted((r.root, r.node) for r in got) == sorted((k, v) for k, vs in want.items() for v in vs)
