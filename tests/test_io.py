"""Sources, sinks and streams on small files."""

from __future__ import annotations

import io
import sqlite3
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import readers, sinks
from corpusloom.streaming import streams


def test_directories_and_archives(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.cl").write_text("kernel void A() {}")
    (tmp_path / "d" / "e" / "b.c").write_bytes(b"\xff\xfe bad")
    (tmp_path / "d" / "c.txt").write_text("no")
    want = {("a.cl", "kernel void A() {}", True), ("b.c", readers.UNREADABLE, False)}
    shown = lambda df: {(r.path.rsplit("/", 1)[1], r.text, r.readable) for r in df.collect()}
    assert shown(readers.corpus_root(spark, f"file://{tmp_path}/d")) == want
    with tarfile.open(tmp_path / "x.tar", "w") as t:
        t.add(tmp_path / "d", "d")
    assert shown(readers.archive_files(spark, str(tmp_path / "x.tar"))) == want


def test_sqlite_and_tool_output(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("create table files (path text, text text)")
    con.executemany("insert into files values (?, ?)", [(f"p{i}", f"t{i}") for i in range(25)])
    con.commit()
    con.close()
    got = readers.sqlite_table(spark, str(tmp_path / "a.db"), "SELECT path, text FROM files", "path string, text string", rows=10)
    assert got.count() == 25 and got.distinct().count() == 25
    out = spark.createDataFrame([(1, "cpu,1.5,2\ngpu,3,4\n")], "id long, said string")
    assert sorted(map(tuple, readers.tool_rows(out, "said", "device string, a double, b int").collect())) == [(1, "cpu", 1.5, 2), (1, "gpu", 3.0, 4)]
    kv = spark.createDataFrame([("vocab_a", "1"), ("vocab_b", "2"), ("done", "x")], "key string, value string")
    assert readers.metadata(kv, "vocab_", True).count() == 2 and readers.metadata(kv, "done").first().value == "x"


@pytest.mark.parametrize("kind", ["json", "jsonzip", "sql", "csv"])
def test_table_sinks(spark, tmp_path, kind):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, text string")
    sinks.write(df, f"file://{tmp_path}/t", kind)
    name, options = sinks.FORMATS[kind]
    assert sorted(map(tuple, spark.read.format(name).options(**options).schema(df.schema).load(f"file://{tmp_path}/t").collect())) == [("a", "x"), ("b", "y")]
    with pytest.raises(ValueError, match="no sink"):
        sinks.write(df, "x", "tape")


def test_zip_folder_and_append(spark, tmp_path):
    df = spark.createDataFrame([("a", "x\ny"), ("b", "é"), ("c", None)], "path string, text string").coalesce(1)
    found = {}
    for r in sinks.zipped(df, 2).collect():
        with zipfile.ZipFile(io.BytesIO(r.archive)) as z:
            found |= {n: z.read(n).decode() for n in z.namelist()}
    assert found == {"a": "x\ny", "b": "é", "c": ""}
    sinks.write(df.union(spark.createDataFrame([("d/e.c", "z\n")], df.schema)), f"file://{tmp_path}/f", "folder")
    written = {str(p.relative_to(tmp_path / "f")): p.read_bytes().decode() for p in (tmp_path / "f").rglob("*") if p.is_file()}
    assert written == {"a": "x\ny", "b": "é", "c": "", "d/e.c": "z\n", "_SUCCESS": ""}
    sinks.write(df, f"file://{tmp_path}/z", "zip")
    with zipfile.ZipFile(next((tmp_path / "z").glob("*.zip"))) as z:
        assert {n: z.read(n).decode() for n in z.namelist()} == found
    with pytest.raises(Exception, match="not below"):
        sinks.write_folder(spark.createDataFrame([("../x", "y")], df.schema), f"file://{tmp_path}/f")
    df.write.parquet(f"file://{tmp_path}/p")
    sinks.append_absent(spark.createDataFrame([("a", "no"), ("d", "z"), ("d", "z")], "path string, text string"), f"file://{tmp_path}/p", "path")
    assert sorted(r.path for r in spark.read.parquet(f"file://{tmp_path}/p").collect()) == ["a", "b", "c", "d"]
    good, bad = sinks.split_valid(df, F.length("text") > 1)
    assert (good.count(), bad.count()) == (1, 2)


def test_stream_routes_good_and_bad_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok"), (2, None), (2, "ok")], "id long, text string")
    df.write.parquet(f"file://{tmp_path}/in")
    stream = streams.file_stream(spark, f"file://{tmp_path}/in", df.schema)
    streams.route(stream, F.col("text") == "ok", f"file://{tmp_path}/good", f"file://{tmp_path}/bad", f"file://{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/good").count() == 2 and spark.read.parquet(f"file://{tmp_path}/bad").count() == 1
    seen = []
    streams.observe(streams.file_stream(spark, f"file://{tmp_path}/in", df.schema), [lambda b, n: seen.append(b.count()) or True], f"file://{tmp_path}/state2").awaitTermination()
    assert sum(seen) == 3


def test_telemetry_falls_back(spark, tmp_path):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        readers.telemetry(spark, f"file://{tmp_path}").count()
    (tmp_path / "a.pbtxt").write_text("loss: 0.5\n  step: 3\n}\n")
    got = readers.telemetry(spark, f"file://{tmp_path}").select("step", "key", "value").collect()
    assert sorted(map(tuple, got)) == [(0, "loss", "0.5"), (1, "step", "3")]
    (tmp_path / "b.json").write_text('{"loss": 0.25}\n')
    assert [r.loss for r in readers.telemetry(spark, f"file://{tmp_path}").collect()] == [0.25]
