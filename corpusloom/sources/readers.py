"""Sources: directories of source files, archives, CSV, tool output, SQLite databases, key/value tables."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from corpusloom.sources.archives import ARCHIVES, archive_members

#: What stands for a file that is no valid UTF-8.
UNREADABLE = "/*unreadable*/"


def source_files(spark: SparkSession, path: str, endings: tuple[str, ...] = (".c", ".cl")) -> DataFrame:
    """(path, text, readable) of all files below a folder with one of the endings; bad UTF-8 is replaced by UNREADABLE."""
    pattern = "*{" + ",".join(endings) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", F.coalesce(text, F.lit(UNREADABLE)).alias("text"), text.isNotNull().alias("readable"))


def archive_files(spark: SparkSession, archive: str, endings: tuple[str, ...] = (".c", ".cl")) -> DataFrame:
    """source_files of a tar or zip archive on a mounted path, read where it lies."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return archive_members(spark, archive, endings).select("path", F.coalesce(text, F.lit(UNREADABLE)).alias("text"), text.isNotNull().alias("readable"))


def corpus_root(spark: SparkSession, root: str) -> DataFrame:
    """Files of a folder, an archive, a SQLite database (table files) or a Parquet table, by what the root is."""
    if root.endswith(ARCHIVES):
        return archive_files(spark, root)
    if root.endswith((".db", ".sqlite")):
        return sqlite_table(spark, root, "files", "path string, text string")
    if root.endswith(".parquet"):
        return spark.read.parquet(root)
    return source_files(spark, root)


def csv_table(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", str(header).lower()).csv(path)


def tool_rows(df: DataFrame, output: str, schema: str) -> DataFrame:
    """Rows of a tool's standard output, one CSV row on each line; lines that don't parse give nulls."""
    lines = df.withColumn("_line", F.explode(F.split(output, "\n"))).where(F.trim("_line") != "")
    return lines.withColumn("_row", F.from_csv("_line", schema)).select(*[c for c in df.columns if c != output], "_row.*")


def metadata(df: DataFrame, key: str, prefix: bool = False) -> DataFrame:
    """Values of a key, or of all keys with a prefix, of a (key, value) table."""
    return df.where(F.col("key").startswith(key) if prefix else F.col("key") == key)


#: Partitions of a SQLite table or query at most; keys that lie far apart then have longer ranges.
MOST_PARTS = 1_000


class _SQLitePart(InputPartition):
    """Keys from low to high, or (null) those that are null, or (no bounds) all rows."""

    def __init__(self, low: int | None, high: int | None, null: bool = False):
        self.low, self.high, self.null = low, high, null


class _SQLiteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.source, self.key = options["source"], options.get("key")

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        if not self.key:
            return [_SQLitePart(None, None)]
        con = self._connect()
        try:
            low, high = (con.execute(f"SELECT {f}({self.key}) FROM {self.source}").fetchone()[0] for f in ("min", "max"))
            # row numbers lie close together as a rule, so they tell about how many rows there are
            first, last = (con.execute(f"SELECT {f}(rowid) FROM {self.source}").fetchone()[0] for f in ("min", "max")) if self.options["numbered"] == "1" else (None, None)
        finally:
            con.close()
        parts = [_SQLitePart(None, None, True)] if self.key != "rowid" else []
        if low is None:
            return parts or [_SQLitePart(0, 0)]
        if not (isinstance(low, int) and isinstance(high, int)):
            raise ValueError(f"the key {self.key} has values that are no integers")
        span = high - low + 1
        most = span if first is None else min(span, last - first + 1)
        n = min(int(self.options["parts"]), -(-most // int(self.options["rows"])))
        return parts + [_SQLitePart(low + span * k // n, low + span * (k + 1) // n - 1) for k in range(n)]

    def read(self, partition: _SQLitePart):
        con = self._connect()
        try:
            select = f"SELECT {self.options['selected']} FROM {self.source}"
            if partition.null:
                yield from con.execute(f"{select} WHERE {self.key} IS NULL")
            elif partition.low is not None:
                yield from con.execute(f"{select} WHERE {self.key} BETWEEN ? AND ?", (partition.low, partition.high))
            else:
                yield from con.execute(select)
        finally:
            con.close()


class SQLiteSource(DataSource):
    """Rows of a SQLite file that all executors see, in partitions by ranges of an integer key."""

    @classmethod
    def name(cls) -> str:
        return "corpusloom_sqlite"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SQLiteReader(dict(self.options))


def sqlite_table(spark: SparkSession, path: str, query: str, columns: str, rows: int = 100_000, key: str | None = None, numbered: bool = True, most_parts: int = MOST_PARTS) -> DataFrame:
    """Rows of a table (``query`` is its name) or of a query, in partitions of about ``rows`` keys, ``most_parts`` at most.

    The ranges are cut between the least and the greatest key, which an index gives at once, and each partition reads
    one range of the index, so all of them together read every row once. A table's key is its rowid unless one
    is given; a query has none unless one of its integer columns is named (one that an index serves), and is then
    one partition, read by one cursor. Equal rows stay; rows whose key is null are a partition of their own. A table
    without row numbers needs ``key``, and ``numbered`` false."""
    table = re.fullmatch(r"\w+", query) is not None
    names = ", ".join(f'"{f.name}"' for f in StructType.fromDDL(columns)) if table else "*"
    options = {"path": os.path.expandvars(path).removeprefix("file://"), "source": f'"{query}"' if table else f"({query})", "selected": names, "columns": columns, "rows": rows, "parts": most_parts, "numbered": int(table and numbered)}
    key = key or ("rowid" if table else None)
    if key:
        options["key"] = key
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("corpusloom_sqlite").options(**options).load()


def database(spark: SparkSession, url: str, table: str) -> DataFrame:
    """A table by URL: jdbc URLs go to Spark's own source, whose driver must be on the class path."""
    if not url.startswith("jdbc:"):
        raise ValueError(f"no source for {url}")
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).load()


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a training log: the JSON lines of ``*.json``; of a folder without them the ``key: value`` lines of
    ``*.pbtxt`` (path, step: number of the line, key, value); an error where there are neither."""
    from pyspark.errors import AnalysisException

    files = lambda pattern, kind: spark.read.format(kind).option("pathGlobFilter", pattern).load(path)
    if not files("*.json", "binaryFile").select("path").isEmpty():
        return files("*.json", "json")
    lines = spark.read.option("pathGlobFilter", "*.pbtxt").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("step", "line"))
    rows = lines.select("path", F.col("step").cast("long").alias("step"), F.regexp_extract("line", r"^\s*(\w+):", 1).alias("key"), F.trim(F.regexp_extract("line", r"^\s*\w+:(.*)$", 1)).alias("value")).where("key <> ''")
    if rows.isEmpty():
        raise AnalysisException(f"no telemetry in {path}")
    return rows
