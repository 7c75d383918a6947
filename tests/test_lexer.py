"""Lexing, canonical names, vocabulary and atoms against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import lexer as lx
from corpusloom.functions.tokens import META
from corpusloom.operators import lexing

OPERATORS = ["<<=", ">>=", "...", "->", "++", "--", "&&", "||", "<<", ">>", "##", "-=", "+=", "*=", "/=", "%=", "&=", "|=", "^=", "<=", ">=", "==", "!="]
SPACE = " \t\n\x0b\f\r"


def word_char(c, first=False):
    return c == "_" or c.isalpha() or (not first and c.isdecimal())


def literal_end(s, i):
    """End of the literal that the quote at i opens, or None."""
    k = i + 1
    while k < len(s) and s[k] != "\n":
        if s[k] == s[i]:
            return k + 1
        if s[k] == "\\":
            if k + 1 >= len(s):
                return None
            k += 1
        k += 1
    return None


def lex_by_hand(s):
    """All tokens with white space, a character at a time."""
    out, i = [], 0
    while i < len(s):
        c, k = s[i], i + 1
        meta = next((m for m in META if s[i:].startswith("[") and s[i + 1 :].lstrip(" \t").startswith(m[1:-1]) and s[i + 1 :].lstrip(" \t")[len(m) - 2 :].lstrip(" \t").startswith("]")), None)
        if c in SPACE:
            while k < len(s) and s[k] in SPACE:
                k += 1
        elif meta:
            k = s.index("]", i) + 1
        elif s.startswith("//", i):
            k = s.find("\n", i) if "\n" in s[i:] else len(s)
        elif s.startswith("/*", i) and s.find("*/", i + 2) >= 0:
            k = s.find("*/", i + 2) + 2
        elif c in "\"'" and literal_end(s, i):
            k = literal_end(s, i)
        elif word_char(c, True):
            while k < len(s) and word_char(s[k]):
                k += 1
        elif c in "0123456789" or (c == "." and s[i + 1 : i + 2] and s[i + 1] in "0123456789"):
            k += c == "."
            while k < len(s) and (s[k].isascii() and (s[k].isalnum() or s[k] in "_.") or s[k] in "+-" and s[k - 1] in "eEpP"):
                k += 1
        else:
            k = i + max([len(o) for o in OPERATORS if s.startswith(o, i)], default=1)
        out.append(s[i:k])
        i = k
    return out


SOURCES = [
    "kernel void A(global float* a, const int b) { int c = get_global_id(0); a[c] = b + .5e-3f; }",
    'int main() { char *s = "a \\"quoted\\" // no comment"; return s[0] == \'\\\'\'; } // end',
    "a+++b <<= 3; x->y.z... /* open and\n closed */ /* never closed",
    "[START] int [ HOLE ] [ENDHOLE] [END] [NOTHING] [PAD", "", " \t\n", "don't can't", "0x1p-3+1e5-e5", "été_1 日本 ÿ", "\\", "'\\", "#define X(a) a##_x",
]


@pytest.fixture(scope="module")
def random_sources():
    rng = random.Random(7)
    bits = ["int ", "float", "a", "b1", "_x", " ", "\n", "\t", '"', "'", "\\", "//", "/*", "*/", "1", ".5", "e", "+", "-", "e-", "[", "]", "HOLE", "END", ">", "<", "=", "&", "|", ".", "é", "#", "(", ")", ";"]
    return SOURCES + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]


def test_lexemes(spark, random_sources):
    rows = spark.createDataFrame([(x,) for x in random_sources], "s string").select("s", lx.lexemes(F.col("s")).alias("w")).collect()
    for r in rows:
        assert "".join(r.w) == r.s
        assert r.w == lex_by_hand(r.s), r.s


def test_very_long_tokens(spark):
    long = ['"' + "a\\\"" * 3_000 + "b" * 100_000 + '"', "/*" + "x\n" * 100_000 + "*/", "n" * 200_000, "1" * 200_000, " " * 200_000, "//" + "y" * 200_000]
    rows = spark.createDataFrame([(x,) for x in long], "s string").select("s", lx.lexemes(F.col("s")).alias("w")).collect()
    assert all(r.w == [r.s] for r in rows)


def keys(spark, *texts):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, s string").select("k", lx.canonical_key(F.col("s")).alias("key")).collect()
    return [r.key for r in sorted(rows)]


def test_canonical_content(spark):
    one = "int f(int a, int b) { return a + b; }"
    same = ["int  f(int a,int b)\n{ return a+b; }", "int g(int x, int y) { return x + y; }", "int b(int f, int a) { return f + a; }"]
    other = [
        "int f(int a, int b) { return a + a; }",  # binds differently
        "int f(int a, int b) { return b + a; }",
        "int f(int a, int b) { return a - b; }",
        "float f(int a, int b) { return a + b; }",  # keywords are no names
    ]
    got = keys(spark, one, *same, *other)
    assert got[: len(same) + 1] == [got[0]] * (len(same) + 1)
    assert len({got[0], *got[len(same) + 1 :]}) == len(other) + 1
    calls = keys(spark, "void k(int a) { sin(a); }", "void k(int a) { cos(a); }", "void q(int z) { sin(z); }", "void k(int a) { v.x = a; }", "void k(int a) { v.y = a; }", "void sin(int a) { sin(a); }", "void cos(int a) { cos(a); }")
    assert calls[0] == calls[2] != calls[1] and calls[3] != calls[4] and calls[5] == calls[6] != calls[0]
    assert keys(spark, 's = "x y"', "s = 'x y'", "s = x", None)[3] is None


def canonical_by_hand(s):
    w = [x for x in lex_by_hand(s) if x[0] not in SPACE]
    at = lambda i: w[i] if 0 <= i < len(w) else ""
    name = lambda x: word_char(x[0], True) and x not in lx.KEYWORDS
    word = lambda x: bool(x) and word_char(x[0], True)
    declared = {x for i, x in enumerate(w) if name(x) and at(i + 1) == "(" and word(at(i - 1)) and at(i - 1) not in lx.BEFORE_CALLS}
    number, out = {}, []
    for i, x in enumerate(w):
        if name(x) and at(i - 1) not in (".", "->") and (at(i + 1) != "(" or x in declared):
            out.append((True, number.setdefault(x, len(number))))
        else:
            out.append((False, x))
    return tuple(out)


def test_canonical_tokens_against_plain_python(spark):
    rng = random.Random(3)
    bits = ["int", "return", "a", "b", "c", "f", "(", ")", ".", "->", "+", ";", "1", " "]
    sources = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in sources], "s string").select("s", lx.canonical_tokens(F.col("s")).alias("c")).collect()
    classes = {}
    for r in rows:
        assert classes.setdefault(tuple(r.c), canonical_by_hand(r.s)) == canonical_by_hand(r.s)
    assert len(classes) == len({canonical_by_hand(r.s) for r in rows})


def test_vocabulary_and_atoms(spark, random_sources, monkeypatch):
    monkeypatch.setattr(lexing, "HOT_ENTRIES", lx.RESERVED + 5)  # most entries are shuffled
    texts = dict(enumerate([*random_sources[:300], "kernel void A(global int* a) { a[0] = fn(1) + fn2; fn2(); }", None]))
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    vocabulary = lexing.lexer_vocabulary(docs)
    entry = {r.token: r["index"] for r in vocabulary.collect()}
    assert len(entry) == vocabulary.count() == len(set(entry.values())) and set(entry.values()) == set(range(len(entry)))
    w = {k: [x if x[0] != "[" or len(x) == 1 else x.replace(" ", "").replace("\t", "") for x in lex_by_hand(s or "") if x[0] not in SPACE] for k, s in texts.items()}
    count = {}
    for tokens in w.values():
        for x in {x for i, x in enumerate(tokens) if not (x[0] in "\"'" and len(x) > 1) and not (x[0] in "0123456789" or x[0] == "." and x[1:2].isdigit()) and x not in META and not (word_char(x[0], True) and x not in lx.KEYWORDS and tokens[i + 1 : i + 2] == ["("])}:
            count[x] = count.get(x, 0) + 1
    assert sorted(count, key=lambda x: (-count[x], x.encode())) == [x for x, i in sorted(entry.items(), key=lambda e: e[1]) if i >= lx.RESERVED]
    literal = lambda x: x[0] in "\"'" and len(x) > 1 or x[0] in "0123456789" or x[0] == "." and x[1:2].isdigit()
    got = {r.doc_id: r for r in lexing.atomized(docs, vocabulary).collect()}
    written = {r.doc_id: r.text for r in lexing.written_out(lexing.atomized(docs, vocabulary), vocabulary).collect()}
    for k, tokens in w.items():
        ids, text, n = [], "", 0
        for x in tokens:
            if x in entry and not literal(x):
                ids.append(entry[x])
                text += x + ("" if x in META else " ")
            else:
                ids += [entry.get(f"{c}-char-based") for c in x]
                text += x.replace("\\", "\\\\")
                n += len(x)
        assert got[k].n_characters == n
        assert got[k].ids == (None if None in ids else ids)
        assert written[k] == (None if None in ids else text)
    empty = docs.limit(0)
    assert lexing.lexer_vocabulary(empty).count() == lx.RESERVED and lexing.atomized(empty, vocabulary).count() == 0


def test_tokens_inside_a_task(spark, random_sources):
    odd = ["a² b½ Ⅷx x๑ ๑x _² été²", "/* a\n */ b", "  x \n", "'\r'", "[ START ]x[ nothing ]"]
    sources = [*random_sources, *odd]
    rows = spark.createDataFrame([*enumerate(sources)], "k long, s string").select("k", lx.tokens(F.col("s")).alias("w")).collect()
    assert {r.k: r.w for r in rows} == {k: lx.text_tokens(x) for k, x in enumerate(sources)}


def test_tokens_are_no_rows(spark):
    """What is moved to encode texts and to write them out again doesn't grow with their tokens."""
    docs = spark.createDataFrame([(k, "a b ( c ) ; " * 50 * (k + 1)) for k in range(20)], "doc_id long, text string")
    vocabulary = lexing.lexer_vocabulary(docs)
    atoms = lexing.atomized(docs, vocabulary)
    for found in (atoms, lexing.written_out(atoms, vocabulary)):
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


SPACES_OF_PYTHON = ["a\x1cb\x1dc", "a\x85b", "a\xa0b \xa0", "a\u2028b\u3000", "\ufeff a"]


def test_words_have_the_tokens_of_their_text(random_sources):
    odd = ["a² b½ Ⅷx x๑ ๑x _² été²", "/* a\n */ b", "'\r'", "[ START ]x[ nothing ]", "a '\\\n' b", "x /=//y\nz /* */ '/*' */", "a/=/ b/ c", "'a'b' c", "f(x) ,;", *SPACES_OF_PYTHON]
    texts = ["", " ", *random_sources, *odd, " a  b ", ""]
    w = [lx.text_tokens(x) for x in texts]
    assert [[*itertools.chain(*map(lx.word_tokens, lx.text_words(x)))] for x in texts] == w
    for some in (slice(None), slice(0, 2), slice(3, 900), slice(len(texts) - 12, None)):
        own = w[some]
        names, code, text = lexing._coded(pa.array(texts, pa.string())[some])
        assert len(set(names)) == len(names)
        assert [names[k] for k in code] == [*itertools.chain(*own)]
        assert text.tolist() == [k for k, x in enumerate(own) for _ in x]


def test_only_distinct_words_are_lexed(monkeypatch):
    seen = []
    monkeypatch.setattr(lx, "text_tokens", lambda x, f=lx.text_tokens: seen.append(len(x)) or f(x))
    names, code, _ = lexing._coded(pa.array(["word a1 + b2(c3); été² " * 50] * 100))
    assert len(code) == 10 * 50 * 100 and len(names) == 10
    assert sum(seen) < 50


def test_digests_of_atoms(spark):
    texts = {0: "a b ( c ) ; 12 'x y'", 1: "", 2: None, 3: "12 'é'", 4: "a " * 3_000, 5: "rare1 rare2 rare1 b"}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    vocabulary = lexing.lexer_vocabulary(docs)
    atoms = {r.doc_id: r for r in lexing.atomized(docs, vocabulary).collect()}
    for r in lexing.atoms(docs, vocabulary).select("doc_id", lexing.digested(F.col("atoms")).alias("d")).select("doc_id", "d.*").collect():
        ids = atoms[r.doc_id].ids
        assert (ids is None) == (r.doc_id == 3)
        assert r.n_atoms == (None if ids is None else len(ids)) and r.n_characters == atoms[r.doc_id].n_characters
        assert r.ids_sha256 == (None if ids is None else hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_answers_carry_no_tokens(spark):
    """A rare token is shuffled once as a question; what comes back names its place."""
    docs = spark.createDataFrame([(k, f"a b{k} ( c )") for k in range(20)], "doc_id long, text string")
    plan = lexing.atomized(docs, lexing.lexer_vocabulary(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(_place" in plan
