"""Text functions, codecs, tokens, distances and set operations on small fixtures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import codecs, features
from corpusloom.functions import text as tx
from corpusloom.functions import tokens as tk
from corpusloom.operators import dedup, ranking

KERNEL = """typedef struct { int a; } S;
__kernel void A(__global int* x) { if (x) { x[0] = 1; } }
int helper(int a) { return a; }
__kernel void B(int y) { y; }
"""


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("min_lines", "a\nb\nc", ("a\nb\nc", True)),
        ("min_lines", "\n\na\nb\n\n", ("fewer than 3 lines", False)),
        ("collapse_empty_lines", "\n\na\n\n \n\nb\n", ("a\n\nb\n", True)),
        ("right_strip_lines", "a  \n b\t\n\n", ("a\n b", True)),
        ("collapse_spaces", "a   b  c", ("a b c", True)),
        ("has_statement", "int a", ("no statement", False)),
        ("drop_includes", "#include <a>\nint x;\n# include <b>", ("int x;", True)),
        ("after_preprocessor_marker", 'a\n# 1 "<stdin>" 2\nint x;\n# 2\ny', ("int x;\ny", True)),
        ("after_preprocessor_marker", "no marker", ("", True)),
        ("plain_keywords", "__kernel void f(__global int* a)", ("kernel void f(global int* a)", True)),
        ("prototype_on_one_line", "void\n f( int  a )\n{ x\n}", ("void f( int a ) { x\n}", True)),
        ("kernel_void", "void kernel f()", ("kernel void f()", True)),
        ("blank_typedefs", "typedef int a;\ntypedef struct b c;\nx", ("\ntypedef struct b c;\nx", True)),
        ("no_secrets", "token: abcdefgh123", ("text has a secret", False)),
    ],
)
def test_stage(spark, name, text, want):
    assert [tuple(x) for x in one(spark, tx.chain(F.col("t"), [name]), t=text)] == [want]


def test_rejected_text_passes_later_stages(spark):
    got = one(spark, tx.chain(F.col("t"), ["min_lines", "has_statement", "collapse_spaces"]), t="a  b")
    assert [tuple(x) for x in got] == [("fewer than 3 lines", False)]
    with pytest.raises(KeyError):
        tx.chain(F.col("t"), ["no such stage"])


def test_comments_and_kernels(spark):
    assert one(spark, tx.strip_comments("t"), t="a/* x */b // y\n\"// no\" '\"'") == "a b  \n\"// no\" '\"'"
    assert one(spark, tx.split_kernels("t"), t=KERNEL) == ["__kernel void A(__global int* x) { if (x) { x[0] = 1; } }", "__kernel void B(int y) { y; }"]
    pairs = one(spark, tx.split_kernels_with_header("t"), t=KERNEL)
    assert pairs[0]["header"] == "typedef struct { int a; } S;" and "helper" in pairs[1]["header"]
    cut = one(spark, tx.cut_typedefs("t"), t=KERNEL)
    assert cut["blocks"] == ["typedef struct { int a; } S;"] and "struct" not in cut["rest"]


def test_codecs(spark):
    assert one(spark, codecs.ints(F.col("t"), "."), t="1.2..3") == [1, 2, 3]
    assert one(spark, codecs.key_values(F.col("t")), t="F2:a/mem:2\ncomp:1.5\nno") == {"F2:a/mem": 2.0, "comp": 1.5}
    assert one(spark, codecs.csv_block(F.col("t")), t="f,k,comp,mem\na,b,1,2\na,c,3,4") == {"comp": 3.0, "mem": 4.0}
    assert [tuple(x) for x in one(spark, codecs.spaces(F.col("t")), t="A:\nx:1\n\nB:\ny:2")] == [("A", "x:1"), ("B", "y:2")]
    assert one(spark, codecs.samples(F.col("t")), t="1\nnan\n2.5\n\n-3e2") == [1.0, 2.5, -300.0]
    assert one(spark, codecs.key_value_text(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.col("n"))), n=1) == "a:1\nb:2"


def test_greedy_tokens_take_the_longest(spark):
    words = ["ab", "abc", "cd", "b"]
    rng = random.Random(1)

    def by_hand(text):
        out, at = [], 0
        while at < len(text):
            best = max((w for w in words if text.startswith(w, at)), key=len, default=text[at])
            out.append(best)
            at += len(best)
        return out

    texts = ["".join(rng.choice("abcd.\n") for _ in range(12)) for _ in range(50)]
    got = spark.createDataFrame([(t,) for t in texts], ["t"]).select("t", tk.greedy_tokens(F.col("t"), words).alias("x")).collect()
    assert all(r.x == by_hand(r.t) for r in got)


def test_instances(spark):
    assert one(spark, tk.padded(tk.wrapped(F.col("a"), 90, 91), 6, 0), a=[1, 2]) == [90, 1, 2, 91, 0, 0]
    assert one(spark, tk.with_hole(F.col("a"), F.lit(1), F.lit(2), 9), a=[1, 2, 3, 4]) == [1, 9, 4]
    m = spark.createDataFrame([([5] * 40, 7), ([5] * 40, 7), ([], 1)], "ids array<int>, s long").select(tk.mask_tokens("ids", "s").alias("m")).collect()
    assert m[0] == m[1] and len(m[0].m.positions) == 6 and m[0].m.labels == [5] * 6 and m[2].m.positions == []


def test_distance_is_not_euclidean(spark):
    assert one(spark, features.feature_distance(F.col("a"), F.col("b")), a=[3.0, 0.0], b=[0.0, 4.0]) == 5.0
    assert one(spark, features.feature_distance(F.col("a"), F.col("b")), a=[2.0], b=[-2.0]) == 0.0
    assert one(spark, features.euclidean(F.col("a"), F.col("b")), a=[2.0], b=[-2.0]) == 4.0


def test_set_operations(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, k string")
    b = spark.createDataFrame([(0, "y"), (3, "z"), (4, "z")], "id long, k string")
    assert sorted(map(tuple, dedup.union_first_wins([a, b], "k", ["id"]).collect())) == [(1, "x"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, dedup.insert_absent(a, b, "k", ["id"]).collect())) == [(3, "z")]
    freq = spark.createDataFrame([("x", 2)], "k string, frequency long")
    assert sorted(map(tuple, dedup.upsert_frequency(freq, spark.createDataFrame([("x",), ("y",)], ["k"]), "k").collect())) == [("x", 3), ("y", 1)]


def test_numbering_and_matching(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 7919) % 1000)
    assert all(r.row_num == r.v for r in ranking.numbered_rows(df, [F.col("v")]).collect())
    pairs = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.5), (2, 10, 0.0), (2, 11, 0.3), (3, 10, 0.2), (3, 11, 0.1), (3, 12, 0.9)], "a long, b long, dist double")
    assert sorted(map(tuple, ranking.greedy_one_to_one(pairs).select("a", "b").collect())) == [(1, 10), (2, 11), (3, 12)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_million_rows_are_numbered_with_their_payload(spark, adaptive):
    n = 1_000_000
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(n, numPartitions=7).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"), "id", F.repeat(F.lit("payload "), 4).alias("p"), F.md5(F.col("id").cast("string")).alias("q"))
        numbered = ranking.numbered_rows(rows, [F.col("k"), F.col("id")])
        assert numbered.columns == ["k", "id", "p", "q", "row_num"]
        got = numbered.agg(F.count("*"), F.countDistinct("row_num"), F.min("row_num"), F.max("row_num"), F.countDistinct("id")).first()
        assert tuple(got) == (n, n, 0, n - 1, n)
        steps = numbered.select("k", "id", F.lag(F.struct("k", "id")).over(Window.orderBy("row_num")).alias("b")).where(F.struct("k", "id") <= F.col("b")).count()
        assert steps == 0
        batched = ranking.batches(rows, [F.col("k"), F.col("id")], 1000, start=500)
        assert tuple(batched.agg(F.count("*"), F.min("offset"), F.max("limit"), F.max("batch_num"), F.min("max_rows")).first()) == (n - 500, 500, n + 500, 1000, n)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_numbering_of_empty_equal_and_clashing_rows(spark):
    rows = spark.createDataFrame([(1, 9), (1, 9), (None, 8)], "a long, row_num long")
    assert sorted((r.a is not None, r.row_num) for r in ranking.numbered_rows(rows, [F.col("a")]).collect()) == [(False, 0), (True, 1), (True, 2)]
    assert ranking.numbered_rows(rows.limit(0), [F.col("a")]).count() == 0


@pytest.mark.parametrize("word", ["const", "constant", "global", "kernel", "local", "private", "read_only", "read_write", "restrict", "write_only"])
def test_each_keyword_loses_its_underscores(spark, word):
    df = spark.createDataFrame([(f"a __{word} b;__inline __{word}",)], "t string")
    assert df.select(tx.plain_keywords(F.col("t"))[0]["text"]).first()[0] == f"a {word} b;__inline {word}"


def test_comments_go_and_literals_stay(spark):
    cases = {"a /* x */ b": "a   b", "a // x\nb": "a  \nb", "'//' \"/* */\" /**/": "'//' \"/* */\"  ", "\"a\\\"//b\" // c": "\"a\\\"//b\"  ", "a / b 'open": "a / b 'open", "/* open": "/* open", "": "", "x" * 100_000 + "//" + "y" * 100_000: "x" * 100_000 + " ", "'" + "a\\'" * 50_000 + "'": "'" + "a\\'" * 50_000 + "'"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert [r.s for r in df.select(tx.strip_comments(F.col("t")).alias("s")).collect()] == [*cases.values(), None]


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 0, 3, 10]), "p") for k in range(500)]
    got = {r.k: r.before for r in ranking.running_sums(spark.createDataFrame(rows, "k long, v long, p string").repartition(3), [F.col("k")], "v").collect()}
    assert got == {k: sum(v or 0 for _, v, _ in rows[:k]) for k, _, _ in rows}


def test_targets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MAX_BROADCAST_TARGETS", 3)
    targets = spark.createDataFrame([(k, float(k)) for k in range(10)], "target_id long, target double")
    samples = spark.createDataFrame([(k, k / 2) for k in range(7)], "node long, features double")
    got = ranking.target_distances(targets, samples, lambda a, b: F.abs(a - b))
    assert sorted((r.target_id, r.node, r.dist) for r in got.collect()) == sorted((a, b, abs(a - b / 2)) for a in range(10) for b in range(7))
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()


def test_tokenizers_by_name(spark):
    assert one(spark, tk.tokenizer("character")(F.col("t")), t="ab c") == ["a", "b", " ", "c"]
    assert one(spark, tk.tokenizer("word", ["ab", "abc"])(F.col("t")), t="xabcab") == ["x", "abc", "ab"]
    with pytest.raises(ValueError):
        tk.tokenizer("ast")
