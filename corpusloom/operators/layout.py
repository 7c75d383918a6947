"""Two-dimensional layouts of vectors: a graph of near neighbours, then rounds of attraction along it and repulsion of sampled
rows, as joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranking import numbered_rows, top_k
from corpusloom.sources.shared import saver

#: Rows of a bucket that are compared with each other; trees of random projections.
BUCKET_ROWS, TABLES = 256, 6


def near_neighbours(rows: DataFrame, row_id: str, vector: str, k: int = 12, tables: int = TABLES, seed: int = 1) -> DataFrame:
    """(a, b, dist, rank): about the k nearest other rows of each row by Euclidean distance, least ids first among equals.

    Each of ``tables`` sets of random projections gives a row a bucket, by the signs of its projections less their means;
    rows of a bucket are compared in chunks of BUCKET_ROWS or so, dealt by a hash, so a bucket of many copies is cut as
    well and no task gets a group that grows. Neighbours that share no chunk are missed; more tables miss fewer.
    Rows with a null id or vector are left out; vectors have one length."""
    spark = rows.sparkSession
    held = saver(spark, "vectors")(rows.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(row_id).cast("long").alias("a"), F.col(vector).cast("array<double>").alias("v")))
    n, size = held.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    schema = "a long, b long, dist double"
    if n < 2 or not size:
        return top_k(spark.createDataFrame([], schema), ["a"], ["dist", "b"], k)
    bits = max(0, int(np.ceil(np.log2(n / BUCKET_ROWS))))
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((tables, bits, size))
    means = np.array(held.agg(*[F.avg(F.get("v", F.lit(j))).alias(f"m{j}") for j in range(size)]).first(), float) if bits else np.zeros(size)

    def bucketed(batches):
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - means
                for table in range(tables):
                    key = ((v @ planes[table].T > 0) << np.arange(bits)).sum(1) if bits else np.zeros(batch.num_rows, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, table)), pa.array(key.astype(np.int64)), *batch.columns], names=["table", "bucket", "a", "v"])

    dealt = held.mapInArrow(bucketed, "table long, bucket long, a long, v array<double>")
    sizes = dealt.groupBy("table", "bucket").agg(F.count("*").alias("n"))  # 2**bits x tables rows, as many as chunks
    chunk = F.pmod(F.xxhash64("table", "a"), F.ceil(F.col("n") / (2 * BUCKET_ROWS)))
    dealt = dealt.join(sizes, ["table", "bucket"]).select("table", "bucket", chunk.alias("chunk"), "a", "v")

    def compared(group: pa.Table) -> pa.Table:
        ids = group["a"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        v = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
        a, b, d = [], [], []
        for i in range(len(ids)):
            far = np.sqrt(((v - v[i]) ** 2).sum(1))
            far[ids == ids[i]] = np.inf
            best = np.argsort(far, kind="stable")[:k]
            best = best[np.isfinite(far[best])]
            a.append(np.full(len(best), ids[i]))
            b.append(ids[best])
            d.append(far[best])
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, d)], names=["a", "b", "dist"])

    found = dealt.groupBy("table", "bucket", "chunk").applyInArrow(compared, schema).groupBy("a", "b").agg(F.min("dist").alias("dist"))
    return top_k(found, ["a"], ["dist", "b"], k)


def layout(rows: DataFrame, row_id: str, vector: str, k: int = 12, rounds: int = 24, samples: int = 4, seed: int = 1) -> DataFrame:
    """(id, x, y): each row near its neighbours. It begins at the two principal components; in each round a row is drawn to its
    neighbours, and they to it, by weight exp(-(rank - 1) / k), and pushed from ``samples`` rows that a hash of row and round
    picks; steps shrink to nothing. The same rows and seed give the same layout up to rounding.

    A round joins links with positions twice and is written to the shared folder; nothing is gathered. Ids that stand in several
    rows count once, with the least vector; an empty table gives an empty table."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark = rows.sparkSession
    one = rows.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull()).groupBy(F.col(row_id).cast("long").alias("id")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"))
    one = saver(spark, "layout")(numbered_rows(one, [F.col("id")], "n"))
    count = one.count()
    if count < 3:
        return one.select("id", F.col("n").cast("double").alias("x"), F.lit(0.0).alias("y"))
    graph = near_neighbours(one, "n", "v", k, seed=seed)
    half = saver(spark, "links")(graph.select("a", "b", F.exp(-(F.col("rank") - 1) / k).alias("w")))
    links = saver(spark, "links")(half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w")))
    x = one.select("n", array_to_vector("v").alias("f"))
    p = PCA(k=2, inputCol="f", outputCol="y").fit(x).transform(x).select("n", vector_to_array("y").alias("p"))
    m = p.agg(*[f(F.get("p", F.lit(j))).alias(f"{n}{j}") for j in (0, 1) for n, f in (("m", F.avg), ("s", F.stddev_pop))])  # one row
    scale = lambda j: (F.get("p", F.lit(j)) - F.col(f"m{j}")) / F.greatest(F.col("s0"), F.lit(1e-12)) * 5
    now = saver(spark, "positions")(p.join(F.broadcast(m)).select("n", scale(0).alias("x"), scale(1).alias("y")))
    clipped = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c))

    def forces(pairs: DataFrame, strength) -> DataFrame:
        other = now.select(F.col("n").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
        met = pairs.join(now.withColumnRenamed("n", "a"), "a").join(other, "b")
        dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
        f: Column = strength(dx * dx + dy * dy)
        return met.select("a", clipped(f * dx).alias("fx"), clipped(f * dy).alias("fy"))

    for step in range(rounds):
        rate = 1.0 - step / rounds
        drawn = forces(links, lambda d2: -2 * F.col("w") / (1 + d2))
        picked = now.select(F.col("n").alias("a"), F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(seed), F.lit(step), F.lit(j), "n"), F.lit(count)) for j in range(samples)])).alias("b"))
        pushed = forces(picked.where("a <> b"), lambda d2: 2 / ((0.01 + d2) * (1 + d2)))
        total = drawn.unionByName(pushed).groupBy("a").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        moved = now.join(total.withColumnRenamed("a", "n"), "n", "left")
        at = lambda c: F.col(c) + rate * 0.25 * F.coalesce(f"f{c}", F.lit(0.0))  # noqa: B023, E731
        now = saver(spark, "positions")(moved.select("n", at("x").alias("x"), at("y").alias("y")))
    return one.select("id", "n").join(now, "n").select("id", "x", "y")
