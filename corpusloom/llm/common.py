"""What several operators of this subpackage share: shared folders, sizes and Arrow columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors see.

    Only where the setting is absent on one machine (tests) a temporary folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = held or tempfile.mkdtemp(prefix="corpusloom-")
        if not held:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_chars(docs: DataFrame, text_col: str = "text") -> int:
    """Characters of all texts, from which the number of blocks follows."""
    return int(docs.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0])


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text, b"" for null."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def values_of(column: pa.Array) -> list[bytes]:
    """The bytes of a string array without nulls, cut from its buffers."""
    if not len(column):
        return []
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def slices(batch: pa.RecordBatch, column: int, bytes_at_once: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in pieces of about so many bytes of a text column, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, bytes_at_once + (int(ends[begin - 1]) if begin else 0), "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(column: str, modulus: int):
    """crc32 of an id as text, modulo: the folds that the contracts name."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


#: Keys that a join broadcasts at most.
HOT_KEYS = 10_000


def join_evenly(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has one row for each key and says in ``count`` how
    many of ``rows`` have it. Keys with more than a HOT_KEYSth of the counted rows, of which there are
    fewer than HOT_KEYS, are broadcast; all others are shuffled, so no task gets a hot key's rows. Both
    tables are read several times: they should be written ones."""
    total = per_key.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.col(count) > max(1, total // HOT_KEYS)
    few, rest = per_key.where(hot).drop(count), per_key.where(~hot).drop(count)
    spread = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(rest.hint("merge"), keys)
    return rows.join(F.broadcast(few), keys).unionByName(spread)


def fields_without(df: DataFrame, names: list[str]) -> list:
    """The fields of ``df`` but those that Spark would take for one of ``names``."""
    same = (lambda x: x) if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    gone = {same(n) for n in names}
    return [f for f in df.schema.fields if same(f.name) not in gone]


_HELD: dict = {}


def held_by_worker(key: tuple, make: Callable[[], object]):
    """What an operator keeps in this Python worker from task to task: the object of one key at a time.
    Workers live through many queries and stages; what an earlier one held goes before the next is made."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def tidy(task: Callable[[Iterator], Iterator], holds: bool = False) -> Callable[[Iterator], Iterator]:
    """The same task, before which the worker drops what held_by_worker holds, unless the task uses that (``holds``), and
    after which it gives memory that it doesn't use back to the system. Workers stay while the executor's other
    workers run, so what a finished stage needed would otherwise count against the next."""

    def tidied(batches: Iterator) -> Iterator:
        if not holds:
            _HELD.clear()
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
            if trim is not None:
                trim(0)

    return tidied


class Kept:
    """A bounded cache in two generations: what a full generation held and nobody asks for again goes."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def missing(self, wanted: set) -> set:
        """Those of ``wanted`` to be learnt; all others are in ``now`` until the next call."""
        fresh = wanted.difference(self.now)
        if len(self.now) + len(fresh) > self.most:
            self.old, self.now, fresh = self.now, {}, wanted
        known = fresh.intersection(self.old)
        self.now.update({k: self.old[k] for k in known})
        return fresh - known

    def fetch(self, keys: list, learn: Callable[[list], list]) -> list:
        """The value of each key; ``learn`` gives those of keys that aren't held. A generation ends between calls."""
        if len(self.now) > self.most:
            self.old, self.now = self.now, {}
        now, old = self.now, self.old
        found = [*map(now.get, keys)]
        fresh = []
        for k in [k for k, v in enumerate(found) if v is None]:
            held = old.get(keys[k])
            if held is None:
                fresh.append(k)
            else:
                now[keys[k]] = found[k] = held
        if fresh:
            for k, value in zip(fresh, learn([keys[k] for k in fresh]), strict=True):
                now[keys[k]] = found[k] = value
        return found
