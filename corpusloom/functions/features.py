"""Feature vectors: distances, proximity, normalisation, target grids (columns in, columns out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feature_distance(target: Column, sample: Column) -> Column:
    """sqrt of the sum of |t**2 - s**2| over the target's components. Not Euclidean, by definition."""
    return F.sqrt(F.aggregate(F.zip_with(target, sample, lambda t, s: F.abs(t * t - s * s)), F.lit(0.0), lambda a, x: a + x))


def euclidean(target: Column, sample: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(target, sample, lambda t, s: (t - s) * (t - s)), F.lit(0.0), lambda a, x: a + x))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def map_distance(target: Column, sample: Column) -> Column:
    """feature_distance over maps: the target's keys in their order; a key the sample lacks gives null."""
    keys = F.array_sort(F.map_keys(target))
    return feature_distance(F.transform(keys, lambda k: target[k]), F.transform(keys, lambda k: sample[k]))


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the divisor isn't above 0."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def relative_proximity(average: Column, target_norm: Column) -> Column:
    """100 (origin - average) / origin, origin the larger of the target's norm and the average; 100 at 0."""
    origin = F.greatest(target_norm, average)
    return F.when(origin > 0, 100 * (origin - average) / origin).otherwise(F.lit(100.0))


def target_grid(maxima: dict[str, int | Column], steps: int = 100) -> Column:
    """Array of maps: every feature at 1/steps, 2/steps, ... of its maximum, rounded down."""
    at = lambda i: [x for k, m in sorted(maxima.items()) for x in (F.lit(k), F.floor(i * m / steps))]
    return F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: F.create_map(*at(i)))


def standardized(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """The column as z-scores within its keys (population deviation; 0 where there is no spread)."""
    w = Window.partitionBy(*keys)
    spread = F.stddev_pop(column).over(w)
    return df.withColumn(column, F.when(spread > 0, (F.col(column) - F.avg(column).over(w)) / spread).otherwise(F.lit(0.0)))


def max_normalized(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """value over the largest of its keys; 1 where that is 0."""
    top = F.max(value).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(top == 0, F.lit(1.0)).otherwise(F.col(value) / top))
