"""Ids with several texts."""

from __future__ import annotations

from corpusloom.llm import near_dedup


def test_near_dedup_keeps_the_other_texts_of_an_id(spark):
    words = [f"w{k}" for k in range(120)]
    a, b, c = " ".join(words[:60]), " ".join(words[60:]), "one two three four five six"
    near = " ".join([*words[60:119], "other"])  # one of 56 shingles differs
    rows = [(1, a), (5, a), (5, b), (9, near), (20, c), (21, "something else"), (30, "something else"), (30, c), (40, "alone")]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 5: 1, 9: 1, 20: 20, 21: 20, 30: 20, 40: 40}
