"""Operator 3: size-tiered compaction of immutable shards under a versioned manifest.

An append writes its rows as small Parquet shards, one or more for each task. Compaction merges
shards of one size tier, oldest first, into files of the target size. Every change is a new
manifest, which names the shards of the table; it appears under its number by one rename that
fails if the number is taken, so readers see whole versions, and of two writers one reads the new
manifest and commits again. A merge reads a group of shards in one task and shuffles nothing.

Rows are stored as they are: nulls, empty and very long texts, repeated rows and columns of any name
but _arrival come back unchanged; the first arrival's schema is the table's.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common

#: Size of a merged file, shards that a tier may hold before it is merged, size of the lowest tier, groups merged by one job.
TARGET_BYTES, FANOUT, LEAST_BYTES, GROUPS_IN_JOB = 128 << 20, 4, 1 << 20, 128
ARRIVALS, ROWS_IN_SHARD = 8, 20_000
#: Seconds for which vacuum leaves a file that no manifest names: another writer may be about to commit it.
GRACE_S = 86_400


@dataclass(frozen=True)
class Shard:
    file: str  # below the table's folder
    bytes: int


class Conflict(Exception):
    """Another writer has committed this version; read the table again and retry."""


def tier(size: int, least: int = LEAST_BYTES, fanout: int = FANOUT) -> int:
    return 0 if size <= least else int(math.log(size / least, fanout)) + 1


def plan(shards: list[Shard], target: int = TARGET_BYTES, fanout: int = FANOUT, least: int = LEAST_BYTES) -> list[list[Shard]]:
    """Groups to merge, each of one tier and in the table's order, up to the target size; none when no tier
    below the target holds ``fanout`` shards. Shards of half the target or more stay as they are."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if 2 * s.bytes < target:
            tiers.setdefault(tier(s.bytes, least, fanout), []).append(s)
    groups = []
    for t in sorted(tiers):
        if len(tiers[t]) < fanout:
            continue
        group: list[Shard] = []
        for s in tiers[t]:
            if group and sum(x.bytes for x in group) + s.bytes > target:
                groups.append(group)
                group = []
            group.append(s)
        groups.append(group)
    return [g for g in groups if len(g) > 1]


class ShardTable:
    """A table of shards in a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._landed: set[str] = set()  # files of arrivals that this writer has yet to commit
        jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.path}/manifest"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], str | None]:
        """Version (the latest), its shards and schema; 0 and none before the first commit."""
        found = self.versions()
        if not found:
            return 0, [], None
        version = found[-1] if version is None else version
        stream = self._fs.open(self._path(f"{self.path}/manifest/v{version:06d}.json"))
        try:
            said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return version, [Shard(**s) for s in said["shards"]], said["schema"]

    def _commit(self, version: int, shards: list[Shard], schema: str) -> None:
        jvm = self.spark._jvm
        temporary = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        final = self._path(f"{self.path}/manifest/v{version:06d}.json")
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:  # NONE: fails where the name is taken
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(temporary, final, options)
        except Exception as e:
            self._fs.delete(temporary, False)
            if not self._fs.exists(final):
                raise
            raise Conflict(f"version {version} of {self.path} is taken") from e

    def _update(self, change: Callable[[list[Shard]], list[Shard] | None], schema: str | None = None) -> int | None:
        """Commits what ``change`` makes of the latest shards, again if another writer was first; the version.
        None where ``change`` gives None."""
        while True:
            version, shards, known = self.manifest()
            new = change(shards)
            if new is None:
                return None
            try:
                self._commit(version + 1, new, self._evolved(known, schema))
            except Conflict:
                continue
            return version + 1

    def _evolved(self, known: str | None, arriving: str | None) -> str | None:
        """The table's schema with the columns of an arrival that it lacks; an error where a column has another type."""
        if known is None or arriving is None:
            return known or arriving
        same = (lambda x: x) if self.spark.conf.get("spark.sql.caseSensitive") == "true" else str.lower
        fields = [T.StructField(f.name, f.dataType) for f in T.StructType.fromJson(json.loads(known)).fields]
        held = {same(f.name): f for f in fields}
        for f in T.StructType.fromJson(json.loads(arriving)).fields:
            own = held.get(same(f.name))
            if own is None:
                fields.append(T.StructField(f.name, f.dataType))
            elif T.StructType([own]).simpleString().lower() != T.StructType([T.StructField(own.name, f.dataType)]).simpleString().lower():
                raise ValueError(f"column {f.name} of {self.path} is {own.dataType.simpleString()}, not {f.dataType.simpleString()}")
        return T.StructType(fields).json()

    def _listed(self, folder: str) -> list[Shard]:
        where = self._path(f"{self.path}/{folder}")
        files = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return [Shard(f"{folder}/{n}", size) for n, size in sorted(files) if n.startswith("part-")]

    def _write(self, df: DataFrame, folder: str, rows: int = 0) -> list[Shard]:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(f"{self.path}/{folder}")
        return self._listed(folder)

    def append(self, df: DataFrame, rows_in_shard: int = ROWS_IN_SHARD) -> int:
        """Adds rows as new shards; the new version. An empty arrival is a version without new rows.

        Columns that the table lacks are added to its schema, and are null in earlier rows; columns that the arrival
        lacks are null in its rows. A column of another type than the table's is an error, and nothing is added."""
        self._evolved(self.manifest()[2], df.schema.json())
        new = self._write(df, f"data/a-{uuid.uuid4().hex[:8]}", rows_in_shard)
        return self._update(lambda shards: shards + new, df.schema.json())

    def append_each(self, df: DataFrame, arrival: Column, arrivals: int = ARRIVALS, rows_in_shard: int = ROWS_IN_SHARD, after: Callable[[], object] = lambda: None) -> int:
        """Adds rows as ``arrivals`` arrivals, whose number (from 0) ``arrival`` gives: one job writes the
        shards of all, then each arrival is committed as a version, and ``after`` is called. The last version.
        Schemas are compared as in ``append``."""
        self._evolved(self.manifest()[2], df.schema.json())
        folder = f"data/a-{uuid.uuid4().hex[:8]}"
        df.withColumn("_arrival", arrival).write.option("compression", "zstd").option("maxRecordsPerFile", rows_in_shard).partitionBy("_arrival").parquet(f"{self.path}/{folder}")
        landed = [self._listed(f"{folder}/_arrival={k}") for k in range(arrivals)]
        self._landed = {s.file for new in landed for s in new}
        version = 0
        for new in landed:
            version = self._update(lambda shards, new=new: shards + new, df.schema.json())
            self._landed -= {s.file for s in new}
            after()
        return version

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT, least: int = LEAST_BYTES) -> int:
        """Merges tiers until none is full, a version for each pass; the last version. Where another writer
        has added shards meanwhile, they stay; where one has merged the same shards, the plan is made anew."""
        while True:
            version, shards, schema = self.manifest()
            groups = plan(shards, target, fanout, least)
            if not groups:
                return version
            new: list[Shard] = []
            for k in range(0, len(groups), GROUPS_IN_JOB):
                merged = None
                for group in groups[k : k + GROUPS_IN_JOB]:
                    one = self._files(group, schema).coalesce(1)
                    merged = one if merged is None else merged.union(one)
                new += self._write(merged, f"data/v{version + 1:06d}-{uuid.uuid4().hex[:8]}-{k}")
            gone = {s.file for g in groups for s in g}
            if self._update(lambda now: new + [s for s in now if s.file not in gone] if gone <= {s.file for s in now} else None) is None:  # noqa: B023
                for s in new:
                    self._fs.delete(self._path(f"{self.path}/{s.file}"), False)

    def _files(self, shards: list[Shard], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{s.file}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        version, shards, schema = self.manifest(version)
        if schema is None:
            raise ValueError(f"{self.path} has no version yet")
        return self._files(shards, schema)

    def vacuum(self, keep: int = 1, grace_s: float = GRACE_S) -> int:
        """Deletes manifests before the last ``keep``, and files older than ``grace_s`` that no kept manifest
        names; files deleted. Only a sole writer may take a grace of 0."""
        found = self.versions()
        named = {s.file for v in found[-keep:] for s in self.manifest(v)[1]} | self._landed
        for v in found[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifest/v{v:06d}.json"), False)
        before, count = (time.time() - grace_s) * 1000, 0
        if not self._fs.exists(self._path(f"{self.path}/data")):
            return 0
        for folder in self._fs.listStatus(self._path(f"{self.path}/data")):
            stays, files = False, self._fs.listFiles(folder.getPath(), True)
            while files.hasNext():
                file = files.next()
                full = file.getPath().toString()
                name = full[full.rindex(f"/data/{folder.getPath().getName()}/") + 1 :]
                if not file.getPath().getName().startswith("part-"):
                    continue
                if name in named or file.getModificationTime() > before:
                    stays = True
                else:
                    self._fs.delete(file.getPath(), False)
                    count += 1
            if not stays and folder.getModificationTime() <= before:
                self._fs.delete(folder.getPath(), True)
        return count


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in ARRIVALS parts, by a hash of the row, and are compacted after each arrival; the
    rows are read back from the files that the last manifest names. A null text counts as empty; rows with
    null or repeated ids are rows like others; an empty table gives an empty table."""
    docs = common.table(spark, sf_dir, "documents")
    held = ShardTable(spark, common.shared_dir(spark, "shards"))

    def compacted() -> None:
        held.compact()
        held.vacuum(grace_s=0)  # nobody else writes to this table

    held.append_each(docs, F.pmod(F.xxhash64("doc_id", "text"), F.lit(ARRIVALS)).cast("int"), after=compacted)
    text = F.coalesce("text", F.lit("")).cast("binary")
    path = F.col("_metadata.file_path")
    merged = F.regexp_extract(path, r"/(v\d+)-[^/]*/part-", 1)
    folder = F.when(merged != "", merged).otherwise(F.concat(F.lit("arrival"), F.regexp_extract(path, r"/_arrival(?:=|%3D)(\d+)/part-", 1)))
    part = F.concat_ws("-", F.regexp_extract(path, r"/(part-\d+)[^/]*$", 1), F.regexp_extract(path, r"[.-](c\d+)[.][^/]*$", 1))
    return held.read().select("doc_id", F.concat_ws("/", folder, part).alias("shard"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))
