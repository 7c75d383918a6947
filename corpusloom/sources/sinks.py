"""Sinks: tables by format, one file or archive member for each row, quarantine of bad rows."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from corpusloom.operators.dedup import insert_absent

FORMATS = {"json": ("json", {}), "jsonzip": ("json", {"compression": "gzip"}), "sql": ("parquet", {}), "csv": ("csv", {"header": "true"}), "parquet": ("parquet", {})}


def write(df: DataFrame, path: str, kind: str, max_rows: int = 500_000) -> None:
    """Writes a table as one of FORMATS, files of ``max_rows`` rows at most; zip and folder are below."""
    if kind == "zip":
        return write_zip(df, path)
    if kind == "folder":
        return write_folder(df, path)
    if kind not in FORMATS:
        raise ValueError(f"no sink {kind}; there are {sorted([*FORMATS, 'zip', 'folder'])}")
    name, options = FORMATS[kind]
    df.write.format(name).options(**options).option("maxRecordsPerFile", max_rows).save(path)


def zipped(df: DataFrame, files: int = 1000) -> DataFrame:
    """(part, number, archive): rows (path, text) in zip archives of ``files`` members at most."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[str, str]] = []

        def archive() -> pa.RecordBatch:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for path, text in held:
                    z.writestr(zipfile.ZipInfo(path), text or "")
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([out.getvalue()], pa.binary())], names=["part", "number", "archive"])

        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((path, text))
                if len(held) >= files:
                    yield archive()
                    number += 1
        if held:
            yield archive()

    return df.select("path", "text").mapInArrow(packed, "part int, number int, archive binary")


class _FilesWriter(DataSourceWriter):
    """Each row (path, content) as a file below a folder; a file appears whole, by one rename, and a task
    that runs again writes the same files again."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator) -> WriterCommitMessage:
        for path, content in iterator:
            full = os.path.normpath(os.path.join(self.folder, path))
            if not full.startswith(self.folder.rstrip("/") + "/"):
                raise ValueError(f"{path} is not below {self.folder}")
            os.makedirs(os.path.dirname(full), exist_ok=True)
            temporary = f"{full}.{uuid.uuid4().hex}.tmp"
            with open(temporary, "wb") as f:
                f.write(content or b"")
            os.replace(temporary, full)
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        os.makedirs(self.folder, exist_ok=True)
        open(os.path.join(self.folder, "_SUCCESS"), "wb").close()


class FilesSink(DataSource):
    """Files in a mounted folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "corpusloom_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FilesWriter(self.options["path"])


def _write_files(df: DataFrame, path: str) -> None:
    folder = path.removeprefix("file://")
    if "://" in folder:
        raise ValueError(f"{path} is no mounted folder")
    df.sparkSession.dataSource.register(FilesSink)
    df.write.format("corpusloom_files").mode("append").option("path", os.path.abspath(folder)).save()


def write_zip(df: DataFrame, path: str, files: int = 1000) -> None:
    """Rows (path, text) in zip files of ``files`` members at most, in a mounted folder."""
    name = F.format_string("part-%05d-%05d.zip", "part", "number")
    _write_files(zipped(df, files).select(name.alias("path"), F.col("archive").alias("content")), path)


def write_folder(df: DataFrame, path: str) -> None:
    """Each row (path, text) as a file of exactly its text, in a mounted folder; of rows with one path one stays,
    a null text is an empty file, a null path an error."""
    _write_files(df.select("path", F.coalesce("text", F.lit("")).cast("binary").alias("content")), path)


def split_valid(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to write and rows to quarantine; a null condition is bad."""
    ok = F.coalesce(good, F.lit(False))
    return df.where(ok), df.where(~ok)


def append_absent(new: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key a Parquet table lacks; of rows with one key the least."""
    old = new.sparkSession.read.parquet(path)
    insert_absent(old, new, key, [c for c in new.columns if c != key]).write.mode("append").parquet(path)
