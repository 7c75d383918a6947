"""Operator 12 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import periodic_runs


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_by_force(w):
    """Every maximal stretch of every period; the least period of each stretch."""
    n, least = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e + q - i >= max(24, 3 * q):
                least.setdefault((i, e + q), q)
            i = e + 1
    return sorted((s, e - s, q) for (s, e), q in least.items())


def collapsed_by_force(w, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def row_by_force(doc_id, text):
    w = words_of(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = runs_by_force(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(listing), sha(collapsed_by_force(w, runs)))


def some_texts(rng, n):
    """Words of small and large alphabets with planted, adjoining, nested and broken repeats."""
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            letters = "ab" if rng.random() < 0.3 else [f"w{k}" for k in range(40)]
            kind = rng.random()
            if kind < 0.5:
                part = [rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 7, 8, 9, 12, 16, 17, 31]))]
                part = (part * 40)[: rng.randint(10, 6 * max(5, len(part)))]
                if rng.random() < 0.3 and part:
                    part[rng.randrange(len(part))] = "broken"
                w += part
            else:
                w += [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        out.append(w)
    return out


@pytest.mark.parametrize("at_once", [1, 50])
def test_runs_of_random_words(at_once, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS_AT_ONCE", 300)
    texts = some_texts(random.Random(5), 400)
    total = 0
    for k in range(0, len(texts), at_once):
        some = texts[k : k + at_once]
        runs, collapsed = periodic_runs._runs_of([" ".join(w).encode() for w in some], None)
        for w, got, left in zip(some, runs, collapsed, strict=True):
            want = runs_by_force(w)
            assert got == want
            assert left.decode() == collapsed_by_force(w, want)
            total += len(want)
    assert total > 200


def test_extensions_of_names():
    rng = random.Random(2)
    w = np.array([rng.choice([0, 1]) if rng.random() < 0.9 else k for k in range(300)])
    owner = np.arange(300) // 100
    names = periodic_runs.Names(w, owner)
    a = np.array([rng.randrange(299) for _ in range(500)])
    b = np.array([rng.randrange(x + 1, 300) for x in a.tolist()])
    for x, y, f, r in zip(a.tolist(), b.tolist(), names.forward(a, b).tolist(), names.backward(a, b).tolist(), strict=True):
        n = 0
        while owner[x] == owner[y] and y + n < 300 and owner[y + n] == owner[x + n] == owner[y] and w[x + n] == w[y + n]:
            n += 1
        assert f == n
        n = 0
        while x - n - 1 >= 0 and owner[x - n - 1] == owner[y - n - 1] and w[x - n - 1] == w[y - n - 1]:
            n += 1
        assert r == n


def test_edge_cases(spark):
    long = "one two three " * 20_000 + "end"
    rows = [(1, None, "x", 1), (2, "", "x", 1), (2, "", "x", 1), (None, "a b " * 30, "x", 1), (3, " \t\n", None, 1), (4, long, "y", 1), (5, "é " * 24, "y", 1), (6, "é " * 23, "y", 1), (7, "x\x1cy " * 30, "y", 1), (8, " ".join(f"word{k}" for k in range(150_000)), "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, RUNS string, period int")
    got = periodic_runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
    found = sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, len(words_of(r.collapsed))) for r in got.collect()), key=str)
    want = [(1, 0, None, None, None, None, 0), (2, 0, None, None, None, None, 0), (2, 0, None, None, None, None, 0), (3, 0, None, None, None, None, 0), (4, 1, 0, 60_000, 3, 20_000_000, 4), (5, 1, 0, 24, 1, 24_000, 1)]
    want += [(6, 0, None, None, None, None, 23), (7, 1, 0, 30, 1, 30_000, 1), (8, 0, None, None, None, None, 150_000), (None, 1, 0, 60, 2, 30_000, 2)]
    assert found == sorted(want, key=str)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 8000")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r) for r in periodic_runs.op12_periodic_runs(spark, f"file://{tmp_path}").collect()}
    want = {i: row_by_force(i, t) for i, t in docs.collect()}
    assert got == want
    assert sum(r[1] > 0 for r in want.values()) > 5
