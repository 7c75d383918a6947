"""Work that grows with the length of a text, not with its square."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from corpusloom.functions import kernels
from corpusloom.functions import lexer as lx


def test_a_long_rest_behind_the_last_brace(spark):
    text = "head kernel void A() { " + "x " * 300_000
    begin = time.time()
    got = spark.createDataFrame([(text,)], "s string").select(kernels.kernels_and_headers(F.col("s")).alias("h")).first().h
    assert time.time() - begin < 30
    assert [(x.kernel, x.header) for x in got] == [(text[5:], "head ")]


def test_a_text_of_very_many_names(spark):
    names = [f"n{k:x}" for k in range(150_000)]
    begin = time.time()
    got = spark.createDataFrame([(" ".join(names),)], "s string").select(lx.canonical_tokens(F.col("s")).alias("c")).first().c
    assert time.time() - begin < 30
    assert got == [f"{lx.RENAMED}{k + 1}" for k in range(len(names))]
