"""The pipeline against a plain Python version of its stages, on a small table with planted cases."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from corpusloom.llm import decontaminate, piece_codec, token_counts
from corpusloom.llm.words import Shingler
from tests.llm.test_small_tables import brute_classes, lines_by_force

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("tor", "lan", "mip", "sed", "gul", "bax") for b in ("ak", "en", "ori", "ul", "ista", "ov", "ey")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(30)) for k in range(5)]
    rows, labels = [], []
    for i in range(400):
        body = [text(rng.randint(5, 60)) for _ in range(rng.randint(1, 4))]
        if i % 8 == 0:
            body[0] += " snorfle grumbo " + text(3) + " snorfle"
        labels.append((i, 1, int(i % 8 == 0)))
        if i % 10 == 1:
            body.append("this line is in every tenth document")
        if i % 25 == 3:
            body.insert(0, items[i // 25 % 5][1])
        rows.append((i, "\n".join(body)))
    rows += [(1000 + i, t + " more words at the end" if i % 2 else t) for i, t in rows[100:140]]
    rows += [(2000, None), (2001, ""), (1000, rows[100][1])]
    path = tmp_path_factory.mktemp("planted")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}", rows, items


def test_pipeline_against_plain_python(spark, planted):
    import sentencepiece

    path, rows, items = planted
    toxic = [r for r in rows if r[1] and "snorfle" in r[1]]
    kept = [r for r in rows if r not in toxic]
    kept = [(i, t) for i, _, _, t in lines_by_force(kept)]
    classes = brute_classes(kept)
    kept = [r for r in kept if classes[r[0]] == r[0]]
    hashes = Shingler().word_hashes
    hit = lambda t: any(decontaminate.nearest(hashes(b.encode()), hashes(t.encode()))[0] <= 0.2 * len(b.split()) for _, b in items)
    kept = [r for r in kept if not hit(r[1])]
    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, r.text, r.token_ids) for r in got) == sorted((i, t, model.encode(t)) for i, t in kept)
    assert all(r.round_trip and r.n_chars == len(r.text) for r in got)
    assert len(toxic) >= 50 and len(kept) > 250


def test_stages_keep_the_columns_of_documents(spark, planted):
    path, rows, _ = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentence_pieces"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), path).count() == 0
    assert set(docs.columns) < set(piece_codec.encode_texts(docs).columns)


def test_empty_benchmark_and_labels(spark, planted, tmp_path):
    path, rows, _ = planted
    for name in ("documents", "benchmark", "labels"):
        table = spark.read.parquet(f"{path}/{name}.parquet")
        (table if name == "documents" else table.limit(0)).write.parquet(f"file://{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.drop_benchmark(spark, docs, f"file://{tmp_path}").count() == len(rows)
    assert corpus_pipeline.drop_toxic(spark, docs, f"file://{tmp_path}").columns == docs.columns
