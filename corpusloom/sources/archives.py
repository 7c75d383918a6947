"""Archives read where they lie: nothing is unpacked to a folder, on the driver or elsewhere.

Of a tar or zip file on a mounted path the driver reads the headers or the central directory only, and deals the
members to partitions by ranges; each task seeks to its members. A compressed tar is one stream, so it is one
partition, read as a stream. Archives in a store that only Spark reads come as rows of its own reader, a file each."""

from __future__ import annotations

import hashlib
import io
import json
import os
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MEMBERS = "path string, content binary"
PACKED = (".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz")
ARCHIVES = (".tar", ".zip", *PACKED)
#: What stands for the hash of an archive that no registry names, as a fixed value.
UNREGISTERED = "temporary_unknown_corpus"


class _Range(InputPartition):
    """Members (name, offset, stored size, method) of one archive; none: the whole of a packed tar."""

    def __init__(self, archive: str, members: list[tuple[str, int, int, int]] | None):
        self.archive, self.members = archive, members


def _local(path: str) -> str:
    path = os.path.expandvars(path).removeprefix("file://")
    if "://" in path:
        raise ValueError(f"{path} is on no mounted path")
    return path


def members_of(archive: str) -> Iterator[tuple[str, int, int, int]]:
    """(name, where it begins, stored bytes, method) of a tar's or zip's files; the data isn't read. Method -1: a tar's
    member, bare at its place; else the zip method of a member that begins with its local header."""
    if archive.endswith(".zip"):
        with zipfile.ZipFile(archive) as z:
            for i in z.infolist():
                if not i.is_dir():
                    if i.flag_bits & 1 or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                        raise ValueError(f"{i.filename} in {archive} is encrypted or packed by method {i.compress_type}")
                    yield i.filename, i.header_offset, i.compress_size, i.compress_type
        return
    with tarfile.open(archive, "r:") as tar:
        for m in tar:
            if m.isreg():
                yield m.name, m.offset_data, m.size, -1
            tar.members = []  # else the file keeps all headers


def _content(f, offset: int, size: int, method: int) -> bytes:
    f.seek(offset)
    if method < 0:
        return f.read(size)
    head = f.read(30)
    f.seek(int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"), 1)
    data = f.read(size)
    return zlib.decompress(data, -15) if method == zipfile.ZIP_DEFLATED else data


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        at_once, bytes_at_once = int(self.options["members"]), int(self.options["bytes"])
        endings = tuple(json.loads(self.options["endings"]))
        parts: list[InputPartition] = []
        for archive in json.loads(self.options["paths"]):
            if archive.endswith(PACKED):
                parts.append(_Range(archive, None))
                continue
            held, size = [], 0
            for m in members_of(archive):
                if not m[0].endswith(endings):
                    continue
                if held and (len(held) >= at_once or size + m[2] > bytes_at_once):
                    parts.append(_Range(archive, held))
                    held, size = [], 0
                held.append(m)
                size += m[2]
            if held:
                parts.append(_Range(archive, held))
        return parts

    def read(self, partition: _Range):
        if partition.members is None:
            endings = tuple(json.loads(self.options["endings"]))
            with open(partition.archive, "rb") as f:
                yield from _streamed(f, endings)
            return
        with open(partition.archive, "rb") as f:
            for name, offset, size, method in partition.members:
                yield name, _content(f, offset, size, method)


def _streamed(f, endings: tuple[str, ...]) -> Iterator[tuple[str, bytes]]:
    """Files of a tar, packed or not, as they pass by."""
    with tarfile.open(fileobj=f, mode="r|*") as tar:
        for m in tar:
            if m.isreg() and m.name.endswith(endings):
                yield m.name, tar.extractfile(m).read()
            tar.members = []


class ArchiveSource(DataSource):
    """Files (path, content) of archives on paths that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "corpusloom_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArchiveReader(dict(self.options))


def archive_members(spark: SparkSession, paths: str | list[str], endings: tuple[str, ...] = ("",), members: int = 1000, bytes_at_once: int = 64_000_000) -> DataFrame:
    """(path, content) of all files with one of the endings in archives on a mounted path, in partitions of ``members``
    files and ``bytes_at_once`` stored bytes at most (a larger file has its own). Files of one name stay rows of
    their own, empty ones too; folders and links are left out."""
    found = [_local(p) for p in ([paths] if isinstance(paths, str) else paths)]
    for p in found:
        if not p.endswith(ARCHIVES):
            raise ValueError(f"{p} is no archive; there are {ARCHIVES}")
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("corpusloom_archive").options(paths=json.dumps(found), endings=json.dumps(endings), members=members, bytes=bytes_at_once).load()


def stored_archive_members(spark: SparkSession, path: str, endings: tuple[str, ...] = ("",)) -> DataFrame:
    """(path, content) as archive_members gives them, of archives that Spark's own reader finds at ``path`` (a file, folder
    or pattern in any store). An archive is one row of that reader, 2 GB at most, and one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*{" + ",".join(ARCHIVES) + "}").load(path).select("path", "content")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = io.BytesIO(content.as_py())
                if name.endswith(".zip"):
                    with zipfile.ZipFile(raw) as z:
                        yield from _batches((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and i.filename.endswith(endings))
                else:
                    yield from _batches(_streamed(raw, endings))

    return files.mapInArrow(opened, MEMBERS)


def _batches(rows: Iterator[tuple[str, bytes]], most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.string()), pa.array([r[1] for r in held], pa.binary())], names=["path", "content"])

    for row in rows:
        held.append(row)
        size += len(row[1])
        if size > most or len(held) >= 5000:
            yield batch()
            held, size = [], 0
    yield batch()


def contents_hash(files: DataFrame) -> str:
    """SHA-1 of the sorted SHA-1s (hexadecimal) of all contents: names and order play no part. The hashes are sorted by
    Spark and read one after the other."""
    digest = hashlib.sha1()
    for r in files.select(F.sha1("content").alias("h")).orderBy("h").toLocalIterator():
        digest.update(r.h.encode())
    return digest.hexdigest()


def archive_hash(spark: SparkSession, archive: str, registry: str = "corpus_registry.json", verify: bool = False) -> str:
    """The hash that the registry beside an archive has for it, else that of its contents; without a registry the SHA-256
    of UNREGISTERED. An archive that the registry doesn't name is an error, and so, if ``verify``, is
    one whose contents have another hash than is registered."""
    path = _local(archive)
    listing = os.path.join(os.path.dirname(path), registry)
    if not os.path.exists(listing):
        return hashlib.sha256(UNREGISTERED.encode()).hexdigest()
    with open(listing) as f:
        known = json.load(f)
    name = os.path.basename(path)
    if name not in known:
        raise FileNotFoundError(f"{name} is not in {listing}")
    wanted = known[name].get("hash")
    if wanted and not verify:
        return wanted
    found = contents_hash(archive_members(spark, path))
    if wanted and wanted != found:
        raise ValueError(f"{archive} has the hash {found}, not {wanted}")
    return found
