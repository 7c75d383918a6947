"""A session with the settings that the queries are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    build = SparkSession.builder.master(master).appName("corpusloom").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    build = build.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for key, value in more.items():
        build = build.config(key.replace("__", "."), value)
    return build.getOrCreate()
