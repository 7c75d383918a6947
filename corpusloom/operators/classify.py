"""Classifiers as tables: Gaussian naive Bayes from one pass of class moments, all folds' models out of the same pass, and
the nearest labelled row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a model table that a join broadcasts at most; queries sent to all tasks at once.
MAX_BROADCAST_MODELS, MAX_QUERIES = 100_000, 10_000
#: Share of the greatest variance that is added to all, so that constant features divide by something.
SMOOTHING = 1e-9


def usable(x: Column) -> Column:
    """A feature, 0 where it is null, not a number or infinite."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def class_moments(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, n, mean, m2): count, mean and sum of squared deviations of every feature in every class of ``keys``
    (the label among them). One aggregate, summed in each task before the shuffle; a row for each class and feature."""
    wide = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(usable(F.col(f))).alias(f"_m{k}") for k, f in enumerate(features)], *[F.var_pop(usable(F.col(f))).alias(f"_v{k}") for k, f in enumerate(features)])
    one = [F.struct(F.lit(f).alias("feature"), F.col(f"_m{k}").alias("mean"), (F.col(f"_v{k}") * F.col("n")).alias("m2")) for k, f in enumerate(features)]
    return wide.select(*keys, "n", F.explode(F.array(*one)).alias("_f")).select(*keys, "_f.feature", "n", "_f.mean", "_f.m2")


def merged(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of coarser classes: those of ``keys`` and feature."""
    w = Window.partitionBy(*keys, "feature")  # classes, not rows
    total = moments.withColumn("_n", F.sum("n").over(w)).withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(w) / F.col("_n"))
    shift = F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2)
    return total.groupBy(*keys, "feature").agg(F.first("_n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + shift).alias("m2"))


def leave_one_out(moments: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label, feature, n, mean, m2): for each group the moments of all rows outside it: the total less the group's. All
    folds' training is this one difference; classes that a fold has no row of are left out."""
    total = merged(moments, [label]).withColumnsRenamed({"n": "_n", "mean": "_mean", "m2": "_m2"})
    folds = moments.select(group).distinct().join(F.broadcast(total))  # a row for each label and feature
    own = folds.join(moments, [group, label, "feature"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "mean": F.coalesce("mean", F.lit(0.0)), "m2": F.coalesce("m2", F.lit(0.0))})
    n = F.col("_n") - F.col("n")
    mean = (F.col("_n") * F.col("_mean") - F.col("n") * F.col("mean")) / n
    m2 = F.col("_m2") - F.col("m2") - n * F.col("n") / F.col("_n") * F.pow(mean - F.col("mean"), 2)
    return own.where(n > 0).select(group, label, "feature", n.alias("n"), mean.alias("mean"), F.greatest(m2, F.lit(0.0)).alias("m2"))


def pairwise(moments: DataFrame, group: str, label: str, test: str = "test") -> DataFrame:
    """(test, group, label, feature, n, mean, m2): each group's own moments for each other group to be tested on."""
    others = moments.select(F.col(group).alias(test)).distinct()
    return moments.join(F.broadcast(others), F.col(test) != F.col(group))


def naive_bayes(moments: DataFrame, keys: list[str], label: str, features: list[str]) -> DataFrame:
    """(keys, model): one model for each of ``keys``: an array of its classes in order of label, with the log of their share,
    and mean, variance and the logarithm that a score takes of it by feature. SMOOTHING of the greatest variance of any feature over all classes is added."""
    overall = merged(moments, keys) if keys else merged(moments.withColumn("_one", F.lit(1)), ["_one"])
    added = overall.groupBy(*(keys or ["_one"])).agg((F.max(F.col("m2") / F.col("n")) * SMOOTHING).alias("_added"), F.max("n").alias("_all"))
    joined = moments.join(added, keys) if keys else moments.join(F.broadcast(added.drop("_one")))
    var = F.col("m2") / F.col("n") + F.col("_added")
    entry = F.struct(F.col("mean"), var.alias("var"), F.ln(2 * math.pi * var).alias("log"))
    classes = joined.groupBy(*keys, label).agg(F.ln(F.first("n") / F.first("_all")).alias("prior"), F.map_from_entries(F.collect_list(F.struct("feature", entry))).alias("_f"))
    one = F.struct(F.col(label).alias("label"), "prior", *[F.element_at("_f", F.lit(f)).alias(f"f{k}") for k, f in enumerate(features)])
    return classes.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("model"))


def predicted(rows: DataFrame, models: DataFrame, keys: list[str], features: list[str], column: str = "predicted") -> DataFrame:
    """``rows`` with the likeliest class of the model of their keys (ties: the least label), null where there is no model.

    Models are broadcast if they are MAX_BROADCAST_MODELS at most, else joined by their keys."""
    few = models.limit(MAX_BROADCAST_MODELS + 1).count() <= MAX_BROADCAST_MODELS
    models = models.select(*keys, "model")
    joined = rows.join(F.broadcast(models) if few else models, keys, "left") if keys else rows.join(F.broadcast(models), how="left")
    x = [usable(F.col(f)) for f in features]

    def score(m: Column) -> Column:
        far = [x[k] - m[f"f{k}"]["mean"] for k in range(len(features))]
        parts = [m[f"f{k}"]["log"] + d * d / m[f"f{k}"]["var"] for k, d in enumerate(far)]
        return m["prior"] - sum(parts[1:], parts[0]) / 2

    scored = F.transform("model", lambda m, i: F.struct(score(m).alias("score"), (-i).alias("first"), m["label"].alias("label")))
    return joined.withColumn(column, F.array_max(scored)["label"]).drop("model")


def nearest_rows(queries: DataFrame, rows: DataFrame, vector: str, label: str, query_id: str, row_id: str) -> DataFrame:
    """(query_id, row_id, label, dist): the nearest row of each query by Euclidean distance (ties: the least id), and its label.

    Queries are the stated set: they are sent to all tasks in blocks of MAX_QUERIES; a task keeps one row for each query
    and gives that out, so what is shuffled doesn't grow with the rows of a task. Rows and queries with a null vector
    or id are left out; without rows there is no result."""
    import numpy as np
    import pyarrow as pa

    from corpusloom.operators.ranking import numbered_rows

    queries = queries.where(F.col(query_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(query_id).alias("_q"), F.col(vector).cast("array<double>").alias("_v"))
    n = queries.count()
    numbered = numbered_rows(queries, [F.col("_q")], "_k") if n > MAX_QUERIES else queries.withColumn("_k", F.lit(0))
    source = rows.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(row_id).alias("row"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    schema = f"query {dict(queries.dtypes)['_q']}, row {dict(source.dtypes)['row']}, label {dict(source.dtypes)['label']}, dist double"
    found = None
    for block in range(-(-n // MAX_QUERIES) or 1):
        held = numbered.where(F.floor(F.col("_k") / MAX_QUERIES) == block).select("_q", "_v").collect()
        sent = rows.sparkSession.sparkContext.broadcast(([r["_q"] for r in held], np.array([r["_v"] for r in held], float)))

        def least(batches, sent=sent):
            names, q = sent.value
            best, row, labels = np.full(len(names), np.inf), [None] * len(names), [None] * len(names)
            for batch in batches:
                if not batch.num_rows or not len(names):
                    continue
                ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                order = np.argsort(np.array(ids), kind="stable")
                for k in range(len(names)):
                    d = ((v - q[k]) ** 2).sum(1)[order]
                    at = int(d.argmin())
                    if d[at] < best[k] or (d[at] == best[k] and ids[order[at]] < row[k]):
                        best[k], row[k], labels[k] = d[at], ids[order[at]], tags[order[at]]
            some = [k for k in range(len(names)) if row[k] is not None]
            columns = [[names[k] for k in some], [row[k] for k in some], [labels[k] for k in some], [float(np.sqrt(best[k])) for k in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query", "row", "label", "dist"])

        kinds = _arrow_types(rows.sparkSession, schema)
        part = source.mapInArrow(least, schema)
        found = part if found is None else found.unionByName(part)
    nearest = found.groupBy("query").agg(F.min(F.struct("dist", "row", "label")).alias("_n"))
    return nearest.select(F.col("query").alias(query_id), F.col("_n.row").alias(f"nearest_{row_id}"), F.col("_n.label").alias(label), F.col("_n.dist").alias("dist"))


def _arrow_types(spark, schema: str) -> list:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]
