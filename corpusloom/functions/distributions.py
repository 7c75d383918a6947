"""Discrete distributions in sparse form: rows (group..., v, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pmf(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """Share of each value among a group's samples, which may have weights."""
    counts = df.groupBy(*keys, F.col(value).cast("long").alias("v")).agg(F.sum(weight if weight is not None else F.lit(1)).alias("n"))
    return counts.select(*keys, "v", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))).alias("p"))


def combined(a: DataFrame, b: DataFrame, keys: list[str], how) -> DataFrame:
    """Distribution of how(x, y) for independent x of a and y of b of the same group."""
    x, y = a.select(*keys, F.col("v").alias("x"), F.col("p").alias("px")), b.select(*keys, F.col("v").alias("y"), F.col("p").alias("py"))
    both = x.join(y, keys) if keys else x.crossJoin(y)
    return both.groupBy(*keys, how(F.col("x"), F.col("y")).alias("v")).agg(F.sum(F.col("px") * F.col("py")).alias("p"))


def add(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return combined(a, b, keys, lambda x, y: x + y)


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return combined(a, b, keys, lambda x, y: x - y)


def multiply(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return combined(a, b, keys, lambda x, y: x * y)


def negate(a: DataFrame) -> DataFrame:
    return a.withColumn("v", -F.col("v"))


def cdf(a: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.withColumn("cdf", F.sum("p").over(w))


def probability(a: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """P(v >= at), >, <=, <, = for each group."""
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("p"))), F.lit(0.0))
    v = F.col("v")
    return a.groupBy(*keys).agg(part(v >= at).alias("ge"), part(v > at).alias("gt"), part(v <= at).alias("le"), part(v < at).alias("lt"), part(v == at).alias("eq"))


def moments(a: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population variance from a distribution."""
    v, p = F.col("v"), F.col("p")
    mean = F.sum(v * p)
    return a.groupBy(*keys).agg(mean.alias("mean"), (F.sum(v * v * p) - mean * mean).alias("variance"))


def entropy(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Natural-log entropy of the labels of each group."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"))
