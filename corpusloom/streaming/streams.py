"""Streams: unique rows, routing of good and bad rows, running accumulators, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.catalog import register
from corpusloom.sources.shared import shared_path


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream, some files at a time: a work queue that survives restarts."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unique(stream: DataFrame, key: str) -> DataFrame:
    """The first row of each key; state is kept for every key that has been seen."""
    return stream.dropDuplicates([key])


def route(stream: DataFrame, good: Column, accepted: str, rejected: str, checkpoint: str):
    """Good rows to one Parquet table, others to a second; each batch is one pass, cached while both are written."""

    def both(batch: DataFrame, number: int) -> None:
        held = batch.withColumn("batch", F.lit(number)).persist()
        try:
            ok = F.coalesce(good, F.lit(False))
            held.where(ok).write.mode("append").parquet(accepted)
            held.where(~ok).write.mode("append").parquet(rejected)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observe(stream: DataFrame, observers: list[Callable[[DataFrame, int], bool]], checkpoint: str):
    """Calls observers on each batch until one of them returns False."""
    query = None

    def seen(batch: DataFrame, number: int) -> None:
        if not all([o(batch, number) for o in observers]) and query is not None:
            query.stop()

    query = stream.writeStream.foreachBatch(seen).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query


def run_to_table(stream: DataFrame, spark: SparkSession, mode: str, label: str) -> DataFrame:
    """All that a stream gives now, as a table in the shared folder."""
    path, checkpoint = shared_path(spark, label), shared_path(spark, f"{label}-state")
    schema = stream.schema
    if mode == "append":
        stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    else:  # the last state of an accumulator
        stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(path)).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    stream = file_stream(spark, f"{path}*", spark.read.parquet(path).schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@register("stream_frequency", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def stream_frequency(spark, sf_dir):
    """Running counts and means by key, with their state in a checkpoint."""
    s = _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return run_to_table(s, spark, "complete", "frequency").select("event_type", "n", F.round("mean", 6).alias("mean"))


@register("stream_unique", "SELECT DISTINCT user_id FROM events")
def stream_unique(spark, sf_dir):
    """Keys as they are first seen."""
    return run_to_table(unique(_events(spark, sf_dir).select("user_id"), "user_id"), spark, "append", "unique")


@register("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Counts by hour with a watermark (beyond the reference; Spark's own windows)."""
    w = _events(spark, sf_dir).withWatermark("ts", "2 days").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return run_to_table(w, spark, "complete", "windows").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
