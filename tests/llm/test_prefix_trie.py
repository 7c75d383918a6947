"""Operator 11 against a trie of Python dictionaries, and against its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from corpusloom.llm import prefix_trie


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def trie_by_force(rows):
    """Rows of (conv_id, turn, role, text) to the rows of the contract."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    children = defaultdict(int)
    for x in members:
        if x:
            children[x[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for x, m in members.items():
        for d in range(len(x) + 1):
            leaves[x[:d]] += children[x] == 0
            saved[x[:d]] += (len(m) - 1) * len(x[-1][1].encode()) if x else 0
    out = []
    for x, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(x))))
        out.append((min(m), len(x), min(members[x[:-1]]) if x else None, len(m), children[x], leaves[x], saved[x], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


COLUMNS = "conv_id long, turn long, role string, text string, place int, HI string, n_convs string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], COLUMNS)


def test_small_and_odd_conversations(spark):
    rng = random.Random(4)
    rows = []
    for c in range(-12, 150):
        if rng.random() < 0.15:
            continue
        for k in range(rng.choice([1, 2, 3, 3, 8, 9, 12, 30])):
            rows.append((c, k, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "bb", None, ""])))
        if rng.random() < 0.2:
            rows.append((c, None, "system", "rules"))
        if rng.random() < 0.2:
            rows += [rows[-1]] * 2 + [(c, 1, "user", "a tie"), (c, 1, "user", "another tie")]
    rows += [(None, 1, "user", "no conversation")]
    rng.shuffle(rows)
    want = trie_by_force(rows)
    assert len(want) > 300 and max(r[1] for r in want) > 20
    got = prefix_trie.prefix_trie(frame(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "hi", "lo"]
    assert found(got) == want


def test_one_conversation_with_most_rows(spark, monkeypatch):
    """A long conversation is cut into several tasks; another begins with its turns."""
    monkeypatch.setattr(prefix_trie.common, "HOT_KEYS", 4)
    rows = [(10, k, "user", f"turn {k % 7}") for k in range(700)] + [(11, k, "user", f"turn {k % 7}") for k in range(650)]
    rows += [(c, k, "user", f"of {c % 3} {k}") for c in range(20, 60) for k in range(5)]
    assert found(prefix_trie.prefix_trie(frame(spark, rows))) == trie_by_force(rows)


def test_same_conversation_very_often(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie.common, "HOT_KEYS", 4)
    rows = [(c, k, "user", f"common {k}") for c in range(300) for k in range(12)]
    rows += [(1000 + c, 0, "user", f"own {c}") for c in range(300)]
    assert found(prefix_trie.prefix_trie(frame(spark, rows))) == trie_by_force(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")], [(3, None, None, None)], [(1, 0, "user", "x" * 1_000_000)]])
def test_nearly_empty_tables(spark, rows):
    assert found(prefix_trie.prefix_trie(frame(spark, rows))) == trie_by_force(rows)


def test_rollup_of_a_forest(spark):
    rng = random.Random(9)
    up, depth = {}, {}
    for k in range(1, 400):
        up[k] = None if rng.random() < 0.01 or k == 1 else rng.randrange(max(1, k - 3), k)
        depth[k] = 0 if up[k] is None else depth[up[k]] + 1
    total = {k: k for k in up}
    for k in sorted(up, reverse=True):
        if up[k]:
            total[up[k]] += total[k]
    nodes = spark.createDataFrame([(k, -k, up[k], up[k] and -up[k], depth[k], k) for k in up], "hi long, lo long, up_hi long, up_lo long, depth long, size long")
    assert {r["hi"]: r["size"] for r in prefix_trie.rollup(nodes, ["size"]).collect()} == total
    assert max(depth.values()) > 60
    assert prefix_trie.rollup(nodes.limit(0), ["size"]).count() == 0


def test_query_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    got = prefix_trie.op11_prefix_trie(spark, sf)
    want = con.execute(prefix_trie.OP11_SQL)
    assert [c[0] for c in want.description] == got.columns
    assert found(got) == sorted(want.fetchall(), key=str)
    assert found(got) == trie_by_force([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
