"""Training logs: event files of framed records, text and JSON logs, and one table of epochs out of whichever there is."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCALARS = "path string, place long, wall_time double, step long, tag string, value double"
LOSS = "training/total_loss"


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0x82F63B78 * (n & 1)
        out.append(n)
    return out


_CRC = _crc_table()


def masked_crc32c(data: bytes) -> int:
    """The CRC-32C of data, turned by 15 bits and with the format's constant added."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ _CRC[(crc ^ b) & 0xFF]
    crc ^= 0xFFFFFFFF
    return (crc >> 15 | crc << 17) + 0xA282EAD8 & 0xFFFFFFFF


def records(data: bytes) -> Iterator[bytes]:
    """Records of a file: length, its checksum, contents, their checksum. Ends at the first record that is cut off or
    whose checksums are wrong, as a log that is still written does."""
    at = 0
    while at + 12 <= len(data):
        head = data[at : at + 8]
        (length,) = struct.unpack("<Q", head)
        body = data[at + 12 : at + 12 + length]
        end = at + 16 + length
        if end > len(data) or struct.unpack("<I", data[at + 8 : at + 12])[0] != masked_crc32c(head) or struct.unpack("<I", data[end - 4 : end])[0] != masked_crc32c(body):
            return
        yield body
        at = end


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in wire format: integers for varints, bytes for all else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if kind == 2:
            size = varint()
        if size is None or at + size > len(message):
            raise ValueError("no message in wire format")
        yield key >> 3, message[at : at + size]
        at += size


def scalars_of(data: bytes) -> Iterator[tuple[int, float, int, str, float]]:
    """(place, wall time, step, tag, value) of the scalars of an event file."""
    for place, record in enumerate(records(data)):
        wall_time, step, values = 0.0, 0, []
        for number, value in fields(record):
            if number == 1:
                (wall_time,) = struct.unpack("<d", value)
            elif number == 2:
                step = value - (1 << 64) if value >> 63 else value
            elif number == 5:
                values += [v for n, v in fields(value) if n == 1]
        for v in values:
            one = dict(fields(v))  # the last of several counts
            if 1 in one and 2 in one:
                yield place, wall_time, step, one[1].decode(errors="replace"), struct.unpack("<f", one[2])[0]


def event_scalars(spark: SparkSession, path: str, pattern: str = "events.out.tfevents*") -> DataFrame:
    """(path, place, wall_time, step, tag, value) of all scalars in a folder's event files, in any store that Spark reads;
    a file is one task. place: number of the record in its file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                columns = list(zip(*scalars_of(content.as_py()), strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(columns[0]), pa.string()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["path", "place", "wall_time", "step", "tag", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(read, SCALARS)


EPOCHS = "timestamp string, epoch long, wall_ms long, loss double"


def epochs_of_scalars(scalars: DataFrame, tag: str = LOSS) -> DataFrame:
    """Epochs of a tag's scalars in the order of file and record: each but the first, with the whole seconds (halves to even)
    since the one before. (One run's log, which is in one window.)"""
    at = F.bround("wall_time", 0).cast("long")
    w = Window.partitionBy("tag").orderBy("path", "place")
    rows = scalars.where(F.col("tag") == tag).withColumns({"_at": at, "_before": F.lag(at).over(w)}).where(F.col("_before").isNotNull())
    return rows.select(F.col("_at").cast("string").alias("timestamp"), F.col("step").alias("epoch"), (F.col("_at") - F.col("_before")).alias("wall_ms"), F.col("value").alias("loss"))


def epoch_telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """(timestamp, epoch, wall_ms, loss) of a training log: of the files epoch_NN_telemetry.pbtxt if there are any, else of the
    event files, else of training.json; without any of them one row of zeros with a loss of -1. An event log without
    the loss gives that row as well. Missing fields of a text log are empty, 0, 0 and 0, of a JSON log -1."""

    def some(pattern: str) -> bool:
        return not spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").isEmpty()

    none = spark.createDataFrame([("0", 0, 0, -1.0)], EPOCHS)
    if some("epoch_*_telemetry.pbtxt"):
        texts = spark.read.option("pathGlobFilter", "epoch_*_telemetry.pbtxt").text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
        value = lambda key: F.regexp_extract("value", rf'(?m)^\s*{key}:\s*"?([^"\s]*)', 1)
        number = lambda key, kind: F.coalesce(F.when(value(key) != "", value(key)).try_cast(kind), F.lit(0).cast(kind))
        rows = texts.where(F.col("name").rlike(r"^epoch_\d\d+_telemetry\.pbtxt$"))
        return rows.select(value("timestamp_unix_epoch_ms").alias("timestamp"), number("epoch_num", "long").alias("epoch"), number("epoch_wall_time_ms", "long").alias("wall_ms"), number("loss", "double").alias("loss"))
    if some("events.out.tfevents*"):
        scalars = event_scalars(spark, folder)
        return none if scalars.where(F.col("tag") == LOSS).isEmpty() else epochs_of_scalars(scalars)
    if some("training.json"):
        rows = spark.read.schema("step long, batch_execution_time_ms double, total_loss double").option("multiLine", "true").option("pathGlobFilter", "training.json").json(folder)
        wall = F.coalesce(F.bround("batch_execution_time_ms", 0).cast("long"), F.lit(-1))
        return rows.select(F.lit("0").alias("timestamp"), F.col("step").alias("epoch"), wall.alias("wall_ms"), F.coalesce("total_loss", F.lit(-1.0)).alias("loss"))
    return none
