"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, line_dedup, lm_score, near_dedup, phrase_fingerprint, piece_codec, shard_table, token_counts, token_files, toxicity
from corpusloom.llm.words import Shingler, weighted_jaccard

LINE = "a line that stands in several documents"
ROWS = [
    (5, f"Hello world\n{LINE}\nidiot and scum, you moron", "x", 1),
    (3, f"  {LINE.upper()} \nshort\nshort", "x", 2),
    (3, f"  {LINE.upper()} \nshort\nshort", "x", 2),  # a repeated row
    (None, f"{LINE}\nno id", None, 3),
    (7, None, "y", None),
    (9, "", "y", 5),
    (11, "é ▁ <s> <|endoftext|> \x00 日本 \r\n\t x", "z", 6),
    (13, "word " * 30_000 + "end", "z", 7),  # very long
]
COLUMNS = "doc_id long, text string, n_lines string, bucket int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def lines_by_force(rows):
    first, seen = {}, {}
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= 10:
                    seen.setdefault(key(line), set()).add(i)
    first = {k: min(v) for k, v in seen.items() if len(v) > 1}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or not (key(x) in first and first[key(x)] < i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(docs, empty):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "bucket", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == lines_by_force([r[:2] for r in ROWS])
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup_with_hot_lines(spark, monkeypatch, min_docs):
    monkeypatch.setattr(line_dedup.common, "HOT_KEYS", 4)
    rows = [(i, "\n".join(["this line is everywhere", f"line of group {i % 7}", f"pair number {i // 2}"])) for i in range(60)]
    got = line_dedup.dedup_lines(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, N_LINES string"), min_docs=min_docs)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    holders = Counter(x for _, t in rows for x in t.split("\n"))
    first = {}
    for i, t in rows:
        for x in t.split("\n"):
            first.setdefault(x, i)
    want = {i: "\n".join(x for x in t.split("\n") if holders[x] < min_docs or first[x] == i) for i, t in rows}
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_near_dedup_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dedup.common, "HOT_KEYS", 4)
    monkeypatch.setattr(near_dedup, "CHUNK_ROWS", 5)
    rng = random.Random(12)
    words = [f"w{k}" for k in range(500)]
    shared = [rng.choice(words) for _ in range(70)]
    rows = [(i, "the same text for very many of the documents here") for i in range(50)]
    rows += [(100 + i, " ".join(shared + [rng.choice(words) for _ in range(rng.choice([4, 12, 16, 20, 24]))])) for i in range(50)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == brute_classes(rows)


def test_token_counts(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    want = sorted(((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t, *_ in ROWS), key=str)
    assert sorted((tuple(r) for r in token_counts.count_tokens(docs).collect()), key=str) == want
    assert token_counts.count_tokens(empty).count() == 0


def test_token_counts_of_random_texts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    lengths = token_counts.Lengths(model, {" the": 1}, most=50)
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \n\t▁ab.éT<s>\x00　\r日") for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    assert lengths.counts(texts, at_once=100) == [len(model.encode(t)) for t in texts]


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(token_files.model_path())
    token_files.write_shards(docs, f"file://{tmp_path}/a", shard_ids=20)
    got = sorted(token_files.read_shards(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    order = sorted(((i, t or "") for i, t, *_ in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    token_files.write_shards(empty, f"file://{tmp_path}/b")
    assert token_files.read_shards(spark, f"file://{tmp_path}/b").count() == 0


def pairs_left(symbols, ends):
    """How often each pair stands: from left to right, no place used twice."""
    seen, taken = Counter(), {}
    for k in range(len(symbols) - 1):
        pair = (int(symbols[k]), int(symbols[k + 1]))
        if not ends[k] and taken.get(pair) != k:
            seen[pair] += 1
            taken[pair] = k + 1
    return seen


def random_shard(rng, kind):
    sizes = rng.integers(1, 300, 200)
    tokens = np.minimum(rng.geometric(0.15, sizes.sum()), 40).astype("<u4")
    if kind == "runs":
        tokens = np.repeat(tokens, rng.integers(1, 60, len(tokens)))[: len(tokens)]
    if kind == "copies":
        tokens = np.tile(tokens[:700], 1 + len(tokens) // 700)[: len(tokens)]
    last = np.zeros(len(tokens), bool)
    last[np.cumsum(sizes) - 1] = True
    return tokens, last, sizes


@pytest.mark.parametrize("kind", ["plain", "runs", "copies"])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_repair_grammar_is_exact_complete_and_random_access(kind, seed):
    tokens, last, sizes = random_shard(np.random.default_rng(seed), kind)
    symbols, ends, rules, lengths = token_files.compress(tokens, last, 50)
    assert len(symbols) < 0.8 * len(tokens) and ends.sum() == len(sizes) and (rules < 50 + len(rules)).all()
    assert (token_files.expand(symbols, rules, lengths, 50) == tokens).all()
    assert max(pairs_left(symbols, ends).values(), default=0) < token_files.MIN_COUNT
    for k, n in enumerate(lengths):
        assert len(token_files.expand(np.array([50 + k]), rules, lengths, 50)) == n
    assert (token_files.expand_range(symbols, rules, lengths, 50, 1234, 1300) == tokens[1234:1300]).all()
    if kind == "copies":
        assert lengths.max() > 100  # documents have 300 ids at most; no bound on the rounds


def test_repair_of_tiny_shards():
    for ids in ([], [7], [7, 7], [7] * 9, [1, 2] * 4):
        last = np.zeros(len(ids), bool)
        last[-1:] = True
        symbols, ends, rules, lengths = token_files.compress(np.array(ids, "<u4"), last, 50)
        assert token_files.expand(symbols, rules, lengths, 50).tolist() == ids and ends.sum() == last.sum()


def test_documents_and_ranges_from_the_files(spark, docs, tmp_path):
    token_files.write_shards(docs, f"file://{tmp_path}/a", shard_ids=500)
    whole = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4") for r in token_files.read_shards(spark, f"file://{tmp_path}/a").collect()}
    asked = [(i, b, e) for i in (5, 3, 7, 13) for b, e in ((0, 10**9), (1, 4), (2, 2), (25_000, 25_010))]
    wanted = spark.createDataFrame([*asked, asked[0], (None, 0, 5), (99, 0, 5), (5, None, 2)], "doc_id long, begin long, end long")
    got = token_files.read_documents(spark, f"file://{tmp_path}/a", wanted).collect()
    assert len(got) == len(asked) + 4  # id 3 stands twice
    for r in got:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == whole[r.doc_id][r.begin : r.end].tolist()


def test_a_range_needs_no_other_symbols():
    tokens, last, sizes = random_shard(np.random.default_rng(3), "plain")
    symbols, ends, rules, lengths = token_files.compress(tokens, last, 50)
    first = np.concatenate(([0], np.flatnonzero(ends)[:-1] + 1))
    k = 20
    only = symbols[first[k] : first[k + 1]]
    begin = int(sizes[:k].sum())
    assert (token_files.expand_range(only, rules, lengths, 50, 3, int(sizes[k])) == tokens[begin + 3 : begin + sizes[k]]).all()


def test_encoder_with_a_small_cache_equals_the_library():
    import pyarrow as pa

    own = token_files.Encoder(token_files.model_path(), most=40)
    rng = random.Random(9)
    parts = [" ", "\n", "ab", "'S", "12", "é", "É", "日", "<|endoftext|>", "\x00", "\x7f", "…", "İ", "ß", "\u00ad", "Word", "...", "\x0b", "x'll"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    for k in range(0, 1500, 100):
        got = own.encode(pa.array(["skipped", *texts[k : k + 100]]).slice(1))
        assert [np.frombuffer(b, "<u4").tolist() for b in got] == [own.model.encode(t, add_special_tokens=False).ids for t in texts[k : k + 100]]


def test_toxicity(spark, sf, docs, empty):
    rng = random.Random(2)
    vocabulary = ["tree", "house", "river", "stone", "cloud", "paper", "light", "green"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(40)]
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(40)] = rng.choice(["grumbo", "snarfle", "idiot"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic) if i % 3 else None))
    many, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(many, known)
    assert {"grumbo", "snarfle"} <= set(model.words)
    scored = {r.doc_id: r.toxic_score for r in toxicity.score(many, model).collect()}
    held = [i for i in scored if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((scored[i] >= 0.7) == (i % 5 == 0) for i in held)
    assert len(held) > 200 and right / len(held) > 0.98
    again = toxicity.score(docs, model).collect()
    assert len(again) == len(ROWS) and all(0 <= r.toxic_score <= 1 for r in again)
    assert toxicity.score(empty, model).count() == 0
    without = toxicity.fit(empty.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert len(toxicity.score(docs, without).collect()) == len(ROWS)


def plain_label_model(rows, rounds=50):
    """The label model row by row: rows are (firing voters, label or -1); the posterior of each and the prior."""
    n = toxicity.VOTERS
    start = lambda fired, label: float(label) if label >= 0 else 0.9 if len(fired) >= 2 else 0.3 if fired else 0.02
    posterior, prior = [start(f, y) for f, y in rows], 0.1
    for _ in range(rounds):
        mass = {1: sum(posterior), 0: sum(1 - p for p in posterior)}
        prior = (mass[1] + 1) / (len(rows) + 10)
        share = {k: [(sum(p if k else 1 - p for (f, _), p in zip(rows, posterior, strict=True) if v in f) + 0.5) / (mass[k] + (1 if k else 5)) for v in range(n)] for k in (0, 1)}
        linked = [[0.0] * n for _ in range(n)]
        for k in (0, 1):
            moment = [[0.0] * n for _ in range(n)]
            for (f, _), p in zip(rows, posterior, strict=True):
                off = [(v in f) - share[k][v] for v in range(n)]
                for a in range(n):
                    for b in range(n):
                        moment[a][b] += (p if k else 1 - p) * off[a] * off[b] / max(mass[k], 1)
            for a in range(n):
                for b in range(n):
                    if a != b:
                        spread = math.sqrt(max(moment[a][a], 1e-9) * max(moment[b][b], 1e-9))
                        linked[a][b] += min(1, max(0, moment[a][b] / spread)) / 2
        weight = [1 / (1 + sum(x)) for x in linked]
        new = []
        for f, y in rows:
            odds = math.log(prior / (1 - prior))
            for v in range(n):
                odds += weight[v] * math.log(share[1][v] / share[0][v] if v in f else (1 - share[1][v]) / (1 - share[0][v]))
            new.append(float(y) if y >= 0 else 1 / (1 + math.exp(-odds)))
        done = max(abs(a - b) for a, b in zip(new, posterior, strict=True)) < 1e-6
        posterior = new
        if done:
            break
    return prior, share, weight, posterior


def test_label_model_against_a_plain_version():
    rng = random.Random(10)
    rows = []
    for k in range(160):
        toxic = rng.random() < 0.25
        fired = frozenset(v for v in range(toxicity.VOTERS) if rng.random() < ((0.6 if v < 6 else 0.3) if toxic else 0.05))
        rows.append((fired | {1} if 0 in fired else fired, int(toxic) if k % 4 == 0 else -1))  # voter 1 follows voter 0
    seen = Counter((sum(1 << v for v in f), y) for f, y in rows)
    patterns, labels = (np.array([x[k] for x in seen], np.int64) for k in (0, 1))
    prior, fires, weights = toxicity.label_model(patterns, np.array([*seen.values()], np.int64), labels, rounds=12)
    want = plain_label_model(rows, rounds=12)
    assert math.isclose(prior, want[0], rel_tol=1e-6)
    assert np.allclose(fires.T, [want[1][0], want[1][1]], rtol=1e-6) and np.allclose(weights, want[2], rtol=1e-6)
    assert weights[:2].max() < 0.95 * weights[2:6].mean()  # voters that go together count for less
    learnt = toxicity.fit_linear(toxicity.features(patterns), np.full(len(patterns), 0.5), np.ones(len(patterns)))
    assert np.abs(learnt).max() < 1e-6


def test_unlabelled_documents_shape_the_classifier(spark):
    rows = [(i, f"tree house {'grumbo snarfle' if i % 5 == 0 else 'river stone'} cloud {i}") for i in range(300)]
    labels = spark.createDataFrame([(i, [int(i % 5 == 0), 2][i % 11 == 0]) for i in range(300)], "doc_id long, toxic int")  # 2 is no label
    more = [(1000 + i, f"tree grumbo cloud {i}") for i in range(2000)]
    few, many = (toxicity.fit(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, rows + more))
    assert few.words == many.words and np.abs(few.linear - many.linear).max() > 0.05


def test_clashing_columns_and_empty_inputs_of_toxicity(spark, docs):
    model = toxicity.fit(docs, spark.createDataFrame([(5, 1), (3, 0)], "doc_id long, toxic int"))
    clash = docs.select("doc_id", "text").selectExpr("*", "'x' AS TOXIC_SCORE", "1 AS toxic")
    assert toxicity.score(clash, model).columns == ["doc_id", "text", "toxic", "toxic_score"]


def test_phrase_fingerprint(docs, empty, spark):
    got = phrase_fingerprint.fingerprint_neighbours(docs, block_chars=1).collect()
    order = sorted(((i, t or "") for i, t, *_ in ROWS), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))

    def prints(text):
        phrases = {}
        phrase_fingerprint.parse(text, phrases)
        return phrase_fingerprint.fingerprint(text, phrases)

    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        a, b, c = prints(t), prints(edited), prints(after)
        near = [round(phrase_fingerprint.likeness(a, x), 9) for x in (b, c)]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), phrase_fingerprint.encoded(a), phrase_fingerprint.encoded(b), *near))
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=str) == sorted(want, key=str)
    assert phrase_fingerprint.fingerprint_neighbours(empty).count() == 0
    one = phrase_fingerprint.fingerprint_neighbours(spark.createDataFrame([(1, "abcabc")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


@pytest.mark.parametrize("rows", [
    [(k, t) for k, t in enumerate(["", "a", "aa", "ab", "aaa", "aab", "abc", "é", "日本", "日日日", None, "a", "b"])],
    [(1, "a")], [(1, "aaa"), (0, "b")], [(0, None), (1, None)],
    [(None, f"text number {k % 50} of {k % 7}") for k in range(300)] + [(k, "own " * k) for k in range(20)],
    [(5, f"text number {k} of {k % 7}") for k in range(300)] + [(k, f"own {k}") for k in range(20)] + [(5, "twice")] * 40,
])
def test_phrase_fingerprint_of_short_texts_and_hot_ids(spark, rows):
    got = phrase_fingerprint.fingerprint_neighbours(spark.createDataFrame(rows, "doc_id long, text string"), block_chars=600).collect()

    def prints(text):
        phrases = {}
        phrase_fingerprint.parse(text, phrases)
        return phrase_fingerprint.fingerprint(text, phrases)

    own = Counter((i, len(t or ""), phrase_fingerprint.encoded(prints(t or ""))) for i, t in rows)
    assert Counter((r.doc_id, r.n_chars, r.fingerprint) for r in got) == own
    assert all(r.edited_sha256 == hashlib.sha256(r.edited.encode()).hexdigest() and r.edited_fingerprint == phrase_fingerprint.encoded(prints(r.edited)) for r in got)
    once = [i for i, n in Counter(i for i, _ in rows).items() if n == 1 and i is not None]
    texts = dict(rows)
    for r in got:  # rows whose next one is certain
        if r.doc_id in once and r.doc_id - 1 in once:
            text, after = texts[r.doc_id] or "", texts[r.doc_id - 1] or ""
            assert r.edited == phrase_fingerprint.edited_text(text, after)
            assert math.isclose(r.near_next, phrase_fingerprint.likeness(prints(text), prints(after)))


def test_likeness_estimates_shared_phrases():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    a = text(20_000)
    b = a[:15_000] + text(5_000)
    sets, marks = [], []
    for t in (a, b):
        phrases = {}
        phrase_fingerprint.parse(t, phrases)
        sets.append(set(phrases))
        marks.append(phrase_fingerprint.fingerprint(t, phrases))
    exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(exact - phrase_fingerprint.likeness(*marks)) < 0.15


def brute_classes(rows):
    shingler = Shingler()
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingler.shingles((t or "").encode()))
    by_text, parent = {}, {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, t in rows:
        by_text.setdefault(t or "", []).append(i)
    links = [(a, b) for g in by_text.values() for a, b in zip(g, g[1:], strict=False)]
    links += [(a, b) for k, a in enumerate(ids) for b in ids[:k] if weighted_jaccard(sets[a][0], sets[b][0]) >= 0.8 - 1e-9]
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in ids}


def test_words_of_equals_word_hashes_with_a_small_cache():
    import pyarrow as pa

    rng = random.Random(7)
    texts = ["".join(rng.choice("aB é\t\n\x0b\r ") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    own, other = Shingler(most=5), Shingler()
    for k in range(0, 300, 50):
        got = own.words_of(pa.array(["skipped", *texts[k : k + 50]]).slice(1))
        assert [g.tolist() for g in got] == [other.word_hashes(t.encode()).tolist() for t in texts[k : k + 50]]


def test_near_dedup_against_brute_force(spark, docs, empty):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for j in range(14):
            copy = base.copy()
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                copy[rng.randrange(120)] = rng.choice(words)
            rows.append((i * 100 + j, " ".join(copy)))
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "one  two"), (5004, "a b c d e " * 50), (5005, "a b c d e " * 48), (5000, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame([*rows, (None, "one two")], "doc_id long, text string"))
    got = {r.doc_id: r.class_id for r in got.collect()}
    assert got == brute_classes(rows)
    assert near_dedup.near_duplicates(empty).count() == 0
    assert {r.doc_id for r in near_dedup.near_duplicates(docs).collect()} == {i for i, *_ in ROWS if i is not None}


def test_dart_minhash_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    e = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    w = rng.integers(1, 9, len(e)).astype(float)
    a, b = (e, w), (e[50:], np.maximum(1, w[50:] - rng.integers(0, 3, len(e) - 50)))
    s = near_dedup.dart_minhash([a, b], 1500)
    assert abs((s[0] == s[1]).mean() - weighted_jaccard(a, b)) < 0.05


def test_decontamination(spark, docs, empty):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([5, 16, 30, 60])))) for k in range(20)]
    rows, want = [], {}
    for i in range(300):
        body = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            k, text = items[i // 3 % 20]
            copy = text.split()
            for _ in range(int(0.1 * len(copy))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            at = rng.randint(0, len(body))
            body[at:at] = copy
        rows.append((i, " ".join(body)))
    many = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, "x"), (90, None), (91, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.item_words) for r in decontaminate.benchmark_hits(many, bench).collect()}
    hashes = Shingler().word_hashes
    for i, t in rows:
        for k, item in items:
            d, _ = decontaminate.nearest(hashes(item.encode()), hashes(t.encode()))
            if d <= int(0.2 * len(item.split()) + 1e-9):
                want[i, k] = (d, len(item.split()))
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(got[x] == want[x] for x in got)
    assert all((i, items[i // 3 % 20][0]) in got for i in range(0, 300, 3) if len(items[i // 3 % 20][1].split()) < 10)
    clean = decontaminate.without_benchmark(many.withColumnRenamed("doc_id", "item_id"), bench)
    assert {r.item_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in got}
    assert decontaminate.benchmark_hits(docs, bench).count() == 0
    assert decontaminate.benchmark_hits(empty, bench).count() == 0
    assert decontaminate.benchmark_hits(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("length", [6, 12, 20, 40, 80, 120, 250, 500, 1000, 3000])
def test_recall_by_edit_share_and_length(length):
    import pyarrow as pa

    rng = random.Random(length)
    words = [f"w{k}" for k in range(3000)]

    def edited(item, edits):
        out = list(item)
        for _ in range(edits):
            kind, at = rng.randrange(3), rng.randrange(len(out))
            out[at : at + (kind > 0)] = [] if kind == 2 else [rng.choice(words)]
        return out

    some = lambda n: [rng.choice(words) for _ in range(n)]
    n = 100 if length <= 120 else 10_000 // length + 20
    items = [(k, some(length)) for k in range(n)]
    detector = decontaminate.Detector([(k, " ".join(w).encode()) for k, w in items], 0.8)
    for share in (0.05, 0.1, 0.15, 0.2):
        texts = [" ".join(some(rng.randint(0, 40)) + edited(w, int(share * length + 1e-9)) + some(rng.randint(0, 40))) for _, w in items]
        hits = detector.hits(pa.array(texts))
        found = sum(k in h for (k, _), h in zip(items, hits, strict=True))
        assert found >= 0.9 * n, share
        if length == 500:  # the best part of the whole text, not of what lies around one part of the item
            hashes = Shingler().word_hashes
            for (k, w), h, t in zip(items[:8], hits, texts, strict=False):
                assert k not in h or h[k][0] == decontaminate.nearest(hashes(" ".join(w).encode()), hashes(t.encode()))[0]


def lm_by_force(rows):
    """(id, train, tokens, known, training tokens, base score, score) by the recursion of the smoothed probabilities."""
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["\n"] for _, t, _ in rows]
    words, pairs, triples = Counter(), Counter(), Counter()
    for w, (_, _, train) in zip(tokens, rows, strict=True):
        if train:
            words.update(w)
            pairs.update(zip(["\n", *w], w, strict=False))
            triples.update(zip(["\n", *w], w, w[1:], strict=False))
    n, v = sum(words.values()), len(words)
    p1 = lambda c: (words[c] + 1) / (n + v + 1)
    p2 = lambda b, c: (pairs[b, c] + lm_score.PRIOR * p1(c)) / (words[b] + lm_score.PRIOR)
    p3 = lambda a, b, c: (triples[a, b, c] + lm_score.PAIR_PRIOR * p2(b, c)) / (pairs[a, b] + lm_score.PAIR_PRIOR)
    out = []
    for w, (i, _, train) in zip(tokens, rows, strict=True):
        score = math.log10(p2("\n", w[0])) + sum(math.log10(p3(a, b, c)) for a, b, c in zip(["\n", *w], w, w[1:], strict=False))
        out.append((i, train, len(w), sum(words[t] > 0 for t in w), n, round(sum(math.log10(p1(t)) for t in w), 4), round(score, 4)))
    return sorted(out, key=str)


def rounded(got):
    return sorted(((*r[:5], round(r[5], 4), round(r[6], 4)) for r in got.collect()), key=str)


def test_lm_score(docs, empty, spark):
    from pyspark.sql import functions as F

    rows = [(i, t or "", i is not None and i % 2 == 1 and i != 9) for i, t, *_ in ROWS]
    got = lm_score.lm_scores(docs, (F.col("doc_id") % 2 == 1) & (F.col("doc_id") != 9), block_chars=50)
    assert rounded(got) == lm_by_force(rows)
    assert lm_score.lm_scores(empty, F.lit(True)).count() == 0
    for r in lm_score.lm_scores(docs, F.lit(False)).collect():
        assert r.train_tokens == 0 and math.isclose(r.base_score, r.score, abs_tol=1e-9) and abs(r.score) < 1e-9


@pytest.mark.parametrize("fanout_bits", [1, 2, 10])
def test_lm_score_with_groups_that_ask_in_turn(spark, fanout_bits):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 5, 40, 900]))), i % 3 > 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(4)
    assert rounded(lm_score.lm_scores(df, F.col("train"), block_chars=200, fanout_bits=fanout_bits)) == lm_by_force(rows)


def test_trigram_weights_sum_to_one():
    tokens = "a b a b a c b a b c".split() + ["\n"]
    words, pairs, triples = Counter(tokens), Counter(zip(["\n", *tokens], tokens, strict=False)), Counter(zip(["\n", *tokens], tokens, tokens[1:], strict=False))
    n, v, m, k = len(tokens), len(words), lm_score.PRIOR, lm_score.PAIR_PRIOR
    p1 = {w: (c + 1) / (n + v + 1) for w, c in words.items()} | {"unseen": 1 / (n + v + 1)}
    for a in [*words, "unseen"]:
        p2 = {w: (pairs[a, w] + m * p1[w]) / (words[a] + m) for w in p1}
        assert a == "\n" or math.isclose(sum(p2.values()), 1)
        for b in [*words, "unseen"]:
            p2 = {w: (pairs[b, w] + m * p1[w]) / (words[b] + m) for w in p1}
            assert b == "\n" or math.isclose(sum((triples[a, b, w] + k * p2[w]) / (pairs[a, b] + k) for w in p1), 1)


def test_piece_codec(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    got = piece_codec.encode_texts(docs).collect()
    for r in got:
        t = r.text or ""
        assert r.token_ids == model.encode(t) and r.n_tokens == len(r.token_ids)
        assert r.round_trip == ("▁" not in t) and r.decoded_sha256 == hashlib.sha256(t.replace("▁", " ").encode()).hexdigest()
    assert len(got) == len(ROWS) and piece_codec.encode_texts(empty).count() == 0


def test_clashing_columns_and_ties(docs, spark):
    from pyspark.sql import functions as F

    clash = docs.select("doc_id", "text", F.lit("x").alias("Token_IDs"), F.lit(1).alias("train"), F.lit(2).alias("block"))
    assert piece_codec.encode_texts(clash).columns == ["doc_id", "text", "train", "block", *(n for n, _ in piece_codec.NEW)]
    assert lm_score.lm_scores(clash, F.lit(True)).count() == len(ROWS) == token_counts.count_tokens(clash).count()
    assert phrase_fingerprint.fingerprint_neighbours(clash).count() == len(ROWS)
    tied = spark.createDataFrame([("b a b a",), ("c c a b",)], "text string")
    assert token_counts.frequent_chunks(tied, most=2) == [" a", " b"]  # ties by chunk


def test_piece_codec_equals_the_library_on_random_texts():
    import sentencepiece

    model, own = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path()), piece_codec.Codec(piece_codec.model_path(), most=200)
    rng = random.Random(6)
    parts = [" ", "  ", "\n", "▁", "ab", ".", "é", "T", "<s>", "\x00", "日", "in", "tion", "the", "er", "12", "Unter", "qu"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    for k in range(0, 1500, 100):
        for t, blob in zip(texts[k : k + 100], own.encode(texts[k : k + 100]), strict=True):
            assert np.frombuffer(blob, "<i4").tolist() == model.encode(t)
            assert own.decode(blob) == t.replace("▁", " ")


def test_shard_plan_merges_only_full_tiers():
    make = lambda sizes: [shard_table.Shard(str(k), s) for k, s in enumerate(sizes)]
    assert shard_table.plan(make([10] * 3), 100, 4, 1) == []
    groups = shard_table.plan(make([10, 11, 60, 12, 10, 500, 10]), 40, 4, 1)
    assert [[s.file for s in g] for g in groups] == [["0", "1", "3"], ["4", "6"]]
    assert shard_table.plan([], 100, 4, 1) == []


def test_shard_table(spark, docs, empty, tmp_path):
    held = shard_table.ShardTable(spark, f"file://{tmp_path}/t")
    assert held.manifest() == (0, [], None)
    assert held.append(empty) == 1 and held.read().count() == 0
    for _ in range(6):
        held.append(docs, rows_in_shard=2)
    before, count = held.manifest(), held.read().count()
    assert count == 6 * len(ROWS) and before[0] == 7
    last = held.compact(target=1 << 20, fanout=3, least=1 << 30)
    assert last == 8 and len(held.manifest()[1]) < len(before[1])
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(held.read()) == sorted(str(r) for r in docs.collect() * 6) == rows(held.read(7))
    with pytest.raises(shard_table.Conflict):
        held._commit(8, [], docs.schema.json())
    assert held.vacuum() == 0 and held.versions() == [8]  # files are younger than the grace period
    assert held.vacuum(grace_s=0) > 0 and held.versions() == [8] and rows(held.read()) == sorted(str(r) for r in docs.collect() * 6)


def test_two_writers_of_a_shard_table(spark, docs, tmp_path, monkeypatch):
    a, b = (shard_table.ShardTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    for _ in range(4):
        a.append(docs)
    stale = a.manifest()
    b.append(docs)  # commits version 5 behind a's back
    real, seen = a.manifest, []
    monkeypatch.setattr(a, "manifest", lambda *v: stale if not seen.append(v) and len(seen) == 1 else real(*v))
    assert a.append(docs) == 6 and len(seen) == 2  # the first try met a taken version
    merging, done = a._write, []
    monkeypatch.setattr(a, "_write", lambda *x: (done or done.append(b.append(docs)), merging(*x))[1])
    a.compact(fanout=2)
    assert a.read().count() == 7 * len(ROWS)  # b's shards of the meantime stay
    assert b.vacuum() == 0 and b.read().count() == 7 * len(ROWS)


def test_sharding_query_merges_and_keeps_all_rows(spark, sf):
    got = shard_table.op3_sharding(spark, sf).collect()
    want = [(r.doc_id, len((r.text or "").encode()), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.n_bytes, r.text_sha256) for r in got) == sorted(want)
    folders = {r.shard.split("/")[0] for r in got}
    assert any(f.startswith("v") for f in folders) and len({r.shard for r in got}) < shard_table.ARRIVALS
    assert max(int(f[1:]) for f in folders if f.startswith("v")) > 5  # after several versions


def test_registered_queries_run(spark, sf):
    from corpusloom.llm import queries

    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, query in queries.QUERIES.items():
        got = query(spark, sf)
        if name == "op11_prefix_trie":
            assert got.where("parent_conv_id is null").count() == 1
        elif name == "op13_chat_format":
            assert got.count() == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() + 1
        elif name != "op6_decontaminate":
            assert got.count() == n, name


def test_line_dedup_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(line_dedup.OP9_SQL).fetchall())
    got = line_dedup.op9_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == want


def test_shard_table_with_other_schemas(spark, tmp_path):
    held = shard_table.ShardTable(spark, f"file://{tmp_path}/t")
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    held.append(make([(1, "x")], "id long, a string"))
    held.append(make([(2, "y", 0.5)], "id long, a string, extra double"))
    held.append(make([(3,)], "ID long"))
    files = len(list((tmp_path / "t" / "data").iterdir()))
    for rows, kind in (([("4", "z")], "id string, a string"), ([(4, 1)], "id long, A int"), ([(4, "z", "w")], "id long, a string, EXTRA string")):
        with pytest.raises(ValueError, match="column .* is"):
            held.append(make(rows, kind))
        with pytest.raises(ValueError, match="column .* is"):
            held.append_each(make(rows, kind), F.lit(0), 1)
    assert held.versions() == [1, 2, 3] and len(list((tmp_path / "t" / "data").iterdir())) == files
    want = [(1, "x", None), (2, "y", 0.5), (3, None, None)]
    assert held.read().columns == ["id", "a", "extra"]
    assert sorted(map(tuple, held.read().collect())) == want
    held.compact(fanout=2, least=10**9)
    assert sorted(map(tuple, held.read().collect())) == want and len(held.manifest()[1]) == 1
    assert sorted(map(tuple, held.read(1).collect())) == [(1, "x")]
