"""The buffered writer's three causes of a flush and a restart; insert-if-absent with expiry and in rounds."""

from __future__ import annotations

import time

import pytest
from pyspark.errors import AnalysisException

from corpusloom.streaming import buffered, streams

SCHEMA = "writer string, seq long, op string, payload string"


class Feed:
    """A folder that is streamed file by file."""

    def __init__(self, spark, tmp_path, schema=SCHEMA):
        self.spark, self.schema, self.at, self.n = spark, schema, tmp_path, 0
        (tmp_path / "in").mkdir()

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"file://{self.at}/part{self.n}")
        for f in (self.at / f"part{self.n}").glob("*.parquet"):
            f.rename(self.at / "in" / f"{self.n:03d}.parquet")

    def stream(self):
        return streams.file_stream(self.spark, f"file://{self.at}/in", self.spark.createDataFrame([], self.schema).schema, 1)

    def run(self, out, **trigger):
        return out.writeStream.format("parquet").option("path", f"file://{self.at}/out").option("checkpointLocation", f"file://{self.at}/state").outputMode("append").trigger(**(trigger or {"availableNow": True})).start()

    def rows(self, *order):
        return [tuple(r) for r in self.spark.read.parquet(f"file://{self.at}/out").orderBy(*order).collect()]


def test_rows_bytes_and_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    make = lambda: buffered.buffered(feed.stream(), max_rows=3, max_bytes=10)
    feed.add([("w", 2, "add", "b"), ("w", 1, "add", "a"), ("v", 1, "add", None)])
    feed.run(make()).awaitTermination()
    feed.add([("w", 3, "delete", "a"), ("w", 4, "add", "éééé"), ("w", 5, "add", "xx"), ("w", 6, "add", "left")])
    feed.run(make()).awaitTermination()  # a restart: two rows were waiting in the state
    want = [("w", 0, 0, "rows", 0, 1, "add", "a"), ("w", 0, 0, "rows", 1, 2, "add", "b"), ("w", 0, 0, "rows", 2, 3, "delete", "a"), ("w", 0, 1, "bytes", 0, 4, "add", "éééé"), ("w", 0, 1, "bytes", 1, 5, "add", "xx")]
    assert feed.rows("writer", "flush", "place") == want
    feed.add([("v", 2, "flush", None), ("w", 7, "flush", None), ("w", 8, "flush", None), ("u", 1, "flush", None)])
    feed.run(make()).awaitTermination()
    assert feed.rows("writer", "flush", "place") == [("v", 0, 0, "flush", 0, 1, "add", None), *want, ("w", 0, 2, "flush", 0, 6, "add", "left")]


def written(feed):
    try:
        return len(feed.rows("seq"))
    except AnalysisException:  # the batches so far had no rows
        return 0


def test_age(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([("w", 1, "add", "a"), ("w", 2, "add", "b")])
    feed.add([("w", 3, "add", "c")])
    query = feed.run(buffered.buffered(feed.stream(), max_rows=1000, max_age_ms=4000), processingTime="500 milliseconds")
    try:
        for _ in range(100):
            time.sleep(0.5)
            assert query.isActive, query.exception()
            if len([*(tmp_path / "out" / "_spark_metadata").glob("[0-9]*")]) > 1 and written(feed) >= 3:
                break
    finally:
        query.stop()
    got = feed.rows("flush", "place")
    assert [r[5] for r in got] == [1, 2, 3] and {r[3] for r in got} == {"age"}


def test_slots_split_a_writer(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([("w", k, "add", str(k)) for k in range(100)])
    feed.run(buffered.buffered(feed.stream(), max_rows=7, slots=4)).awaitTermination()
    got = feed.rows("slot", "flush", "place")
    assert [(r[1], r[2], r[4], r[5]) for r in got] == [(s, k // 7, k % 7, 4 * k + s) for s in range(4) for k in range(21)]


def test_absent_keys_and_expiry(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        absent_keys(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def absent_keys(spark, tmp_path):
    feed = Feed(spark, tmp_path, "sha string, n long")
    feed.add([("a", 1), ("a", 1), ("b", 2), (None, 3)])
    feed.add([("a", 4), ("c", 5)])
    feed.run(buffered.insert_absent_stream(feed.stream(), "sha", 20_000)).awaitTermination()
    assert feed.rows("n") == [("a", 1), ("b", 2), (None, 3), ("c", 5)]
    feed.add([("a", 6), ("d", 7)])
    feed.run(buffered.insert_absent_stream(feed.stream(), "sha", 20_000)).awaitTermination()  # a restart keeps the keys
    assert feed.rows("n")[4:] == [("d", 7)]
    time.sleep(21)
    feed.add([("a", 8), ("d", 9)])
    feed.run(buffered.insert_absent_stream(feed.stream(), "sha", 20_000)).awaitTermination()  # forgotten by now
    assert feed.rows("n")[5:] == [("a", 8), ("d", 9)]


def test_rounds(spark, tmp_path):
    feed = Feed(spark, tmp_path, "sha string, n long")
    feed.add([(f"k{i % 25:02d}", i) for i in range(60)])
    feed.add([(f"k{i:02d}", i) for i in range(20, 30)] + [(None, 1)])
    table = f"file://{tmp_path}/table"
    for _ in range(2):  # the second time there is nothing new
        buffered.insert_rounds(feed.stream(), table, "sha", f"file://{tmp_path}/state", 10)
        got = spark.read.parquet(table).collect()
        assert sorted((r.sha or "") for r in got) == sorted(["", *(f"k{i:02d}" for i in range(30))])
        counts = {}
        for r in got:
            counts[r["round"]] = counts.get(r["round"], 0) + 1
        assert counts == {1: 10, 2: 10, 3: 5, 4: 6}
    buffered.insert_rounds(feed.stream(), table, "sha", f"file://{tmp_path}/other-state", 10)  # all batches again
    assert spark.read.parquet(table).count() == 31


@pytest.mark.parametrize("bounds", [{}, {"max_rows": 2}])
def test_empty_stream(spark, tmp_path, bounds):
    feed = Feed(spark, tmp_path)
    feed.add([])
    feed.run(buffered.buffered(feed.stream(), **bounds)).awaitTermination()
    assert feed.spark.read.schema(buffered.BUFFERED).parquet(f"file://{tmp_path}/out").count() == 0
