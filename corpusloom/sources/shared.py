"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only on one machine where that isn't set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="corpusloom-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saver(spark: SparkSession, label: str) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table there and reads it again."""

    def save(df: DataFrame) -> DataFrame:
        path = shared_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save
