"""Set operations that keep the first of equal rows, and upserts by rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order, as a map-side aggregate rather than a sort of all rows."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    least = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return least.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [*order, *rest] if c not in keys]).select(*df.columns)


def union_first_wins(parts: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Union of tables; of rows with one key the one from the earlier table, then the first in order."""
    numbered = [p.withColumn("_source", F.lit(k)) for k, p in enumerate(parts)]
    union = numbered[0]
    for p in numbered[1:]:
        union = union.unionByName(p)
    return first_per_key(union, [key], ["_source", *order]).drop("_source")


def insert_absent(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks, one for each key."""
    return first_per_key(new, [key], order).join(old.select(key), key, "left_anti").select(*new.columns)


def upsert_frequency(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, frequency) of both tables, frequencies summed."""
    return old.select(key, "frequency").unionByName(new.groupBy(key).agg(F.count("*").alias("frequency"))).groupBy(key).agg(F.sum("frequency").alias("frequency"))


def upsert_lists(old: DataFrame, new: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """List columns of equal keys joined, old before new."""
    joined = old.select(key, *lists).alias("o").join(new.select(key, *lists).alias("n"), key, "full_outer")
    empty = lambda c: F.coalesce(c, F.array())
    return joined.select(key, *[F.concat(empty(F.col(f"o.{c}")), empty(F.col(f"n.{c}"))).alias(c) for c in lists])


def chunk_of(number: Column, total: Column, chunks: int) -> Column:
    """Chunk (from 0) of a row number in ``chunks`` equal parts; the rest goes to the last."""
    size = F.greatest(F.floor(total / chunks), F.lit(1))
    return F.least(F.floor(number / size), F.lit(chunks - 1))


def suffix_duplicates(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Names that stand more than once become name-1, name-2, ... in order."""
    w = Window.partitionBy(name)
    return df.withColumn(name, F.when(F.count("*").over(w) > 1, F.concat_ws("-", name, F.row_number().over(w.orderBy(*order)).cast("string"))).otherwise(F.col(name)))
