"""Kernels and their global text against a scan by characters."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.functions import kernels


def by_hand(text):
    first, *chunks = text.split("kernel void")
    out, header = [], first
    for c in chunks:
        opened = closed = at = 0
        while at < len(c) and (opened == 0 or opened != closed):
            opened, closed, at = opened + (c[at] == "{"), closed + (c[at] == "}"), at + 1
        while at < len(c) and c[at] in " \n" and opened and opened == closed:
            at += 1
        out.append(("kernel void" + c[:at], header))
        header += c[at:]
    return out


def test_kernels(spark):
    rng = random.Random(4)
    bits = ["kernel void", " A(int a) ", "{", "}", "{}", " ", "\n", "int g;", "x", "\t"]
    texts = ["", "kernel void", "int g; kernel void A() { if (1) { } } \n int h; kernel void B() {}\n\nend"] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame([*enumerate(texts)], "k int, s string")
    rows = df.select("k", kernels.kernels_and_headers(df.s).alias("h"), kernels.kernels_with_globals(df.s).alias("g"), kernels.kernels_only(df.s).alias("o")).collect()
    for r in rows:
        want = by_hand(texts[r.k])
        assert [(x.kernel, x.header) for x in r.h] == want, texts[r.k]
        assert r.g == [h + k for k, h in want] and r.o == [k for k, _ in want]
    assert spark.range(1).select(kernels.kernels_only(F.lit(None).cast("string")).alias("o")).first().o is None


def test_a_long_kernel(spark):
    text = "kernel void A() {" + "{ x; }\n" * 20_000 + "} tail"
    got = spark.createDataFrame([(text,)], "s string").select(kernels.kernels_and_headers(F.concat("s", F.lit("kernel void B() {}"))).alias("h")).first().h
    assert [len(x.kernel) for x in got] == [len(text) - 4, len("kernel void B() {}")] and got[1].header == "tail"
