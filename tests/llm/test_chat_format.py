"""Operator 13 against a plain fold of the whole log, and an exact round trip."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from corpusloom.llm import chat_format
from corpusloom.llm.chat_format import AGAIN, CONTROLS, DELTA, EDIT, OPEN

COLUMNS = "conv_id long, seq long, kind string, message long, role string, text string, AT string, stretch int"
KEYS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def fold_by_force(log):
    """(conv_id, seq, kind, message, role, text) rows to the turns of each conversation."""
    talks = defaultdict(dict)
    first = lambda x: (x is not None, x)
    for c, _, kind, m, role, text in sorted(log, key=lambda r: (first(r[0]), first(r[1]), first(r[3]), first(r[2]), first(r[5]))):
        talk = talks[c]
        if m is None:
            continue
        if kind == OPEN:
            talk[m] = (role or "", text or "")
        elif kind == DELTA and m in talk:
            talk[m] = (talk[m][0], talk[m][1] + (text or ""))
        elif kind == EDIT and m in talk:
            talk[m] = (talk[m][0], text or "")
        elif kind == AGAIN:
            for k in [k for k in talk if k > m]:
                del talk[k]
            if m in talk:
                talk[m] = (talk[m][0], "")
    return {c: [t[m] for m in sorted(t)] for c, t in talks.items() if t}


def digests_by_force(talks):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for c, turns in talks.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(chat_format.rendered(r, t)[0] for r, t in turns)
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(whole)))
    return sorted(out, key=str)


def some_log(rng, convs, events, most=6):
    """Random events; sequence numbers with ties; texts full of control strings."""
    bits = [*CONTROLS, "<\\s>", "\\", "[\\\\INST]", "é", "\n", "a", "<", "|im_start|>", ""]
    log = []
    for c in convs:
        for seq in range(events(c)):
            kind = rng.choice([OPEN, OPEN, DELTA, DELTA, DELTA, EDIT, AGAIN, "other", None] if rng.random() < 0.5 else [OPEN, DELTA, DELTA])
            m = rng.randint(0, min(most, 1 + seq // 2)) if rng.random() < 0.98 else None
            log.append((c, seq if rng.random() < 0.9 else seq // 2, kind, m, rng.choice(["user", "assistant", "system", None, "odd\nrole\\n<s>"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))])))
    rng.shuffle(log)
    return log


def frame(spark, log):
    return spark.createDataFrame([(*r, "x", 1) for r in log], COLUMNS)


def found(df):
    assert df.columns == KEYS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_control_strings_round_trip():
    rng = random.Random(3)
    bits = [*CONTROLS, "\\", "\\\\", "<", "[", ">", "]", "s", "/", "|", "im_end", "INST", "\n", "n", "é", "<\\s>"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        e = chat_format.escaped(t)
        assert chat_format.unescaped(e) == t and not any(c in e for c in CONTROLS)
        assert chat_format.turns_of(chat_format.rendered(t, t)[0] + chat_format.rendered("x", t)[0]) == [(t, t), ("x", t)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs(spark, seed):
    rng = random.Random(seed)
    log = some_log(rng, [None, *range(200)], lambda c: rng.randint(1, 25))
    chats = chat_format.format_chats(frame(spark, log))
    assert found(chat_format.chat_digests(chats)) == digests_by_force(fold_by_force(log))


def test_one_conversation_with_most_events(spark, monkeypatch):
    """It is cut between tasks, its messages between several."""
    monkeypatch.setattr(chat_format, "BLOCK_CHARS", 500)
    for seed in range(3):
        rng = random.Random(10 + seed)
        log = some_log(rng, [1, 2, 3], lambda c: 3_000 if c == 2 else 5, most=40)
        chats = chat_format.format_chats(frame(spark, log))
        want = fold_by_force(log)
        assert found(chat_format.chat_digests(chats)) == digests_by_force(want)
        blocks = [r for r in sorted(chats.collect(), key=lambda r: (r.conv_id, r["at"])) if r.conv_id == 2]
        assert chat_format.turns_of("".join(r.formatted for r in blocks)) == want[2]
        assert [chat_format.unescaped(r.formatted[s["start"] : s["start"] + s["length"]]) for r in blocks for s in r.loss] == [t for r, t in want[2] if r == "assistant" and t]


def test_small_and_long_logs(spark):
    log = [(7, 1, OPEN, 1, "assistant", "x" * 2_000_000), (7, 2, DELTA, 1, None, "y"), (7, 2, DELTA, 1, None, "y"), (8, 1, DELTA, 1, "user", "never opened"), (9, None, OPEN, 1, None, None)]
    assert found(chat_format.chat_digests(chat_format.format_chats(frame(spark, log)))) == digests_by_force({7: [("assistant", "x" * 2_000_000 + "yy")], 9: [("", "")]})
    assert found(chat_format.chat_digests(chat_format.format_chats(frame(spark, [])))) == []


def test_log_of_conversations(spark):
    rng = random.Random(6)
    rows = [(c, rng.choice([None, *range(4)]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "a", "text of more words " * rng.randint(1, 9)])) for c in [None, *range(60)] for _ in range(rng.randint(1, 6))]
    rows += rows[:9]
    log = chat_format.log_of(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, kind string"))
    kinds = {r.kind for r in log.select("kind").distinct().collect()}
    assert kinds == {OPEN, DELTA, EDIT, AGAIN}
    want = defaultdict(list)
    for c, turn, role, text in rows:
        want[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:16], role or "", text or ""))
    assert found(chat_format.chat_digests(chat_format.format_chats(log))) == digests_by_force({c: [x[3:] for x in sorted(t)] for c, t in want.items()})


def test_query_against_brute_force(spark, sf):
    talks = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks[r.conv_id].append((r.role or "", r.text or ""))
    talks[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert found(chat_format.op13_chat_format(spark, sf)) == digests_by_force(talks)
