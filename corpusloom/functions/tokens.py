"""Vocabularies, encoding and decoding of characters and words, feature-value tokens."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

META = ("[START]", "[END]", "[PAD]", "[MASK]", "[HOLE]", "[ENDHOLE]")


def character_vocabulary(docs: DataFrame, text_col: str = "text", meta: tuple[str, ...] = META) -> DataFrame:
    """(token, index, n): meta tokens first, then characters by falling count, ties by character."""
    chars = docs.select(F.explode(F.split(text_col, "")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token")  # as many rows as the alphabet has letters
    ranked = chars.select("token", (F.row_number().over(w) - 1 + len(meta)).alias("index"), "n")
    first = docs.sparkSession.createDataFrame([(m, k, 0) for k, m in enumerate(meta)], "token string, index int, n long")
    return first.unionByName(ranked)


def greedy_pattern(tokens: list[str]) -> str:
    """A pattern whose matches are the longest tokens at each place, single characters elsewhere."""
    quoted = [re.escape(x) for x in sorted((x for x in tokens if len(x) > 1), key=lambda x: (-len(x), x))]
    return "(?s)" + "|".join([*quoted, "."])


def greedy_tokens(text: Column, tokens: list[str]) -> Column:
    return F.regexp_extract_all(text, F.lit(greedy_pattern(tokens)), F.lit(0))


def tokenizer(kind: str, tokens: list[str] | None = None) -> Callable[[Column], Column]:
    """The tokenizer of a name: character, or word with its list of tokens (others are external programs)."""
    if kind == "character":
        return lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    if kind == "word" and tokens:
        return lambda text: greedy_tokens(text, tokens)
    raise ValueError(f"no tokenizer {kind}; there are character, and word with tokens")


def encoded(tokens: Column, vocabulary: Column) -> Column:
    """Ids by a map from token to id; null for what isn't in it."""
    return F.transform(tokens, lambda x: vocabulary[x])


def decoded(ids: Column, names: Column, skip: Column | None = None) -> Column:
    """Text of ids by an array of tokens, without those to skip."""
    kept = ids if skip is None else F.filter(ids, lambda i: ~F.array_contains(skip, i))
    return F.array_join(F.transform(kept, lambda i: F.get(names, i)), "")


def word_positions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, first_char, word): each word of a text split at spaces, with its place and the character it starts at."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def placed(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                words = pc.split_pattern(batch.column(1), " ")
                flat, n = words.flatten(), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                row, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
                length = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                start = np.cumsum(length) - length
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.arange(len(row)) - first[row]), pa.array(start - start[first[row]]), flat], names=[key, "token", "first_char", "word"])

    rows = df.select(key, F.coalesce(text, F.lit("")).alias(text))
    return rows.mapInArrow(placed, f"{key} {dict(df.dtypes)[key]}, token long, first_char long, word string")


def value_token(value: Column, threshold: int, width: int, last: int) -> Column:
    """Values below the threshold stand for themselves, then ranges of a width, then one open range."""
    return F.when(value < threshold, value).otherwise(F.least(threshold + F.floor((value - threshold) / width), F.lit(last)))


def padded(ids: Column, length: int, pad: int) -> Column:
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def padded_whole(ids: Column, length: int, pad: int) -> Column:
    """Padded to a length; longer ids stay whole."""
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def wrapped(ids: Column, start: int, end: int) -> Column:
    """With start and end ids, where they aren't there."""
    a = F.when(F.get(ids, F.lit(0)) == start, ids).otherwise(F.concat(F.array(F.lit(start)), ids))
    return F.when(F.element_at(a, -1) == end, a).otherwise(F.concat(a, F.array(F.lit(end))))


def with_hole(ids: Column, at: Column, size: Column, hole: int) -> Column:
    """``size`` ids from ``at`` (0 first) replaced by one hole."""
    return F.concat(F.slice(ids, 1, at), F.array(F.lit(hole)), F.slice(ids, at + size + 1, F.greatest(F.size(ids) - at - size, F.lit(0))))


def all_holes(df: DataFrame, ids: str, hole: int) -> DataFrame:
    """Every hole of every row: each start (0 first) with each size that fits, and ``ids`` with the hole in their place.

    n ids give n (n + 1) / 2 rows; none of them is left out."""
    starts = df.withColumn("start", F.explode(F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.size(ids) - 1))))
    holes = starts.withColumn("size", F.explode(F.sequence(F.lit(1), F.size(ids) - F.col("start"))))
    return holes.withColumn(ids, with_hole(F.col(ids), F.col("start"), F.col("size"), hole))


def depth(ids: Column, left: int, right: int) -> Column:
    return F.size(F.filter(ids, lambda x: x == left)) - F.size(F.filter(ids, lambda x: x == right))


def text_depth(text: Column, left: str, right: str) -> Column:
    """depth of a text's own characters, counted without an array of them."""
    return F.length(F.replace(text, F.lit(right), F.lit(""))) - F.length(F.replace(text, F.lit(left), F.lit("")))


_INTS = ArrayType(IntegerType())


def _masked(row, seed: int):
    import numpy as np

    rng = np.random.default_rng(int(seed) & 0xFFFFFFFF)
    n = max(1, int(0.15 * len(row))) if len(row) else 0
    at = np.sort(rng.choice(len(row), n, replace=False)) if n else np.zeros(0, np.int64)
    out, how = row.copy(), rng.random(n)
    out[at[how < 0.8]] = 3
    other = at[(how >= 0.8) & (how < 0.9)]
    out[other] = rng.integers(6, 100, len(other))
    return out, at, row[at]


@F.pandas_udf(StructType().add("input", _INTS).add("positions", _INTS).add("labels", _INTS))
def mask_tokens(ids, seeds):
    """15 % of the ids as positions to predict: of them 80 % masked, 10 % another id, 10 % left, by the row's seed."""
    import numpy as np
    import pandas as pd

    rows = [_masked(np.asarray(row, dtype=np.int64), seed) for row, seed in zip(ids, seeds, strict=True)]
    return pd.DataFrame([tuple(x.tolist() for x in r) for r in rows], columns=["input", "positions", "labels"])


def masked_texts(df: DataFrame, key: str, text: str, seed: Column) -> DataFrame:
    """(key, input, positions, labels): ``mask_tokens`` of the code points of whole texts, a few texts at once."""
    import numpy as np
    import pyarrow as pa

    def lists(parts):
        ends = np.cumsum([0, *map(len, parts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).astype(np.int32)))

    def masked(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                ids = [np.frombuffer(x.encode("utf-32-le"), "<i4") for x in batch.column(1).to_pylist()]
                done = [_masked(row, s) for row, s in zip(ids, batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(lists, zip(*done, strict=True))], names=[key, "input", "positions", "labels"])

    rows = df.select(key, F.coalesce(text, F.lit("")).alias(text), seed.alias("seed"))
    return rows.mapInArrow(masked, f"{key} {dict(df.dtypes)[key]}, input array<int>, positions array<int>, labels array<int>")


def text_ids(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ids): code points of whole texts, a few texts at once; a null text has none."""
    import numpy as np
    import pyarrow as pa

    def coded(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                ids = [np.frombuffer((x or "").encode("utf-32-le"), "<i4") for x in batch.column(1).to_pylist()]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return df.select(key, text).mapInArrow(coded, f"{key} {dict(df.dtypes)[key]}, ids array<int>")


def ids_text(df: DataFrame, key: str, ids: str = "ids", skip: int | None = None) -> DataFrame:
    """(key, text) of code points, without the id to skip."""
    import numpy as np
    import pyarrow as pa

    def decoded(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                rows = [np.asarray(x.values if x.is_valid else [], "<i4") for x in batch.column(1)]
                texts = [(r if skip is None else r[r != skip]).astype("<i4").tobytes().decode("utf-32-le") for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(decoded, f"{key} {dict(df.dtypes)[key]}, text string")
