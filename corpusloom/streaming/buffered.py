"""A buffered writer and an insert-if-absent of bounded rounds, as keyed state of a stream.

State is kept by RocksDB in the stream's checkpoint, so buffers survive a restart; what a batch emits is written
with the batch, so each row comes out once. Ages are processing-time timers, for which Spark runs batches without data
for ever: a stream with ages that is to end with its input (``availableNow``) needs
``spark.sql.streaming.noDataMicroBatches.enabled`` off, and leaves what isn't of age to its next run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators.ranking import numbered_rows
from corpusloom.plans.catalog import register
from corpusloom.sources.shared import shared_path
from corpusloom.streaming.streams import file_stream, run_to_table

FLUSH = "flush"
BUFFERED = T.StructType(
    [T.StructField("writer", T.StringType()), T.StructField("slot", T.LongType()), T.StructField("flush", T.LongType()), T.StructField("cause", T.StringType())]
    + [T.StructField("place", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("payload", T.StringType())]
)
_ROW = T.StructType(BUFFERED.fields[-3:])


def use_rocksdb(df: DataFrame) -> None:
    """The state store that keyed state with timers needs."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Buffer(StatefulProcessor):
    """Rows of one writer's slot, held until there are max_rows, max_bytes of payload, or the first is max_age old."""

    def __init__(self, max_rows: int | None, max_bytes: int | None, max_age_ms: int | None):
        self.max_rows, self.max_bytes, self.max_age_ms = max_rows, max_bytes, max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", _ROW)
        self.meta = handle.getValueState("meta", "n long, bytes long, flushes long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, size, flushes, timer = self.meta.get() if self.meta.exists() else (0, 0, 0, -1)
        in_state, fresh = n > 0, []
        # a batch's rows of one slot, in order; the trigger bounds them
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, op, payload in zip(new["seq"].tolist(), new["op"].tolist(), new["payload"].tolist(), strict=True):
            payload = payload if isinstance(payload, str) else None
            cause = None
            if op == FLUSH:
                cause = "flush" if n else None
            else:
                fresh.append((int(seq), op, payload))
                n, size = n + 1, size + len((payload or "").encode())
                cause = "rows" if self.max_rows and n >= self.max_rows else "bytes" if self.max_bytes and size >= self.max_bytes else None
            if cause:
                yield self._out(key, flushes, cause, in_state, fresh)
                n, size, flushes, in_state, fresh = 0, 0, flushes + 1, False, []
        if fresh:
            self.rows.appendList(fresh)
        if self.max_age_ms:
            if timer >= 0 and not in_state:  # the rows that it was set for are out
                self.handle.deleteTimer(timer)
                timer = -1
            if n and timer < 0:
                timer = timerValues.getCurrentProcessingTimeInMs() + self.max_age_ms
                self.handle.registerTimer(timer)
        self.meta.update((n, size, flushes, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, _, flushes, timer = self.meta.get()
        if n and timer == expiredTimerInfo.getExpiryTimeInMs():
            yield self._out(key, flushes, "age", True, [])
            self.meta.update((0, 0, flushes + 1, -1))

    def _out(self, key, flushes: int, cause: str, in_state: bool, fresh: list[tuple]) -> pd.DataFrame:
        held = [tuple(r) for r in self.rows.get()] if in_state else []
        if in_state:
            self.rows.clear()
        rows = [(*key, flushes, cause, place, *r) for place, r in enumerate(held + fresh)]
        return pd.DataFrame(rows, columns=BUFFERED.names)

    def close(self) -> None:
        pass


def buffered(stream: DataFrame, max_rows: int | None = None, max_bytes: int | None = None, max_age_ms: int | None = None, slots: int = 1) -> DataFrame:
    """Rows as a buffered writer commits them: writer, slot, flush (from 0), cause (rows, bytes, age or flush), place
    in the flush, seq, op, payload; append mode.

    stream: writer, seq (long), op, payload (string, null counts no bytes). A buffer is flushed when it has ``max_rows``
    rows, ``max_bytes`` bytes of payload (UTF-8), when its first row is ``max_age_ms`` old, or at a row whose op is "flush",
    which itself isn't given out. Rows of a batch go in order of seq, behind those of earlier batches; all ops
    but "flush" are rows, so deletions stay between the insertions around them. A buffer's state is below the bounds.
    ``slots`` deals a writer's rows to so many buffers by seq, which splits a busy writer; order then
    holds in each slot, and flush rows must be sent for each (any seq of that remainder)."""
    use_rocksdb(stream)
    keyed = stream.select(F.coalesce("writer", F.lit("")).alias("writer"), F.pmod("seq", F.lit(slots)).cast("long").alias("slot"), "seq", "op", "payload")
    return keyed.groupBy("writer", "slot").transformWithStateInPandas(_Buffer(max_rows, max_bytes, max_age_ms), BUFFERED, "Append", "ProcessingTime" if max_age_ms else "None")


class _Absent(StatefulProcessor):
    """Whether a key was seen, forgotten ``expiry_ms`` after it was last seen."""

    def __init__(self, schema: T.StructType, expiry_ms: int):
        self.schema, self.expiry_ms = schema, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "times long", ttlDurationMs=self.expiry_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        first, n = None, 0
        for part in rows:
            n += len(part)
            if first is None and len(part):
                first = part.iloc[:1]
        before = self.seen.get()[0] if self.seen.exists() else 0
        self.seen.update((before + n,))  # also begins the time anew
        if not before and first is not None:
            yield first[self.schema.names]

    def close(self) -> None:
        pass


def insert_absent_stream(stream: DataFrame, key: str, expiry_ms: int = 0) -> DataFrame:
    """The first row of each key; a key is forgotten ``expiry_ms`` after its last row (0: never), so the state is that of the
    keys of this time. A batch holds a round's rows (limit them at the source: ``maxFilesPerTrigger``); a null
    key is a key like others. Of rows of one key in one round any one stays."""
    use_rocksdb(stream)
    return stream.groupBy(key).transformWithStateInPandas(_Absent(stream.schema, expiry_ms), stream.schema, "Append", "ProcessingTime" if expiry_ms else "None")


def insert_rounds(stream: DataFrame, table: str, key: str, checkpoint: str, rows_per_round: int = 1000) -> None:
    """Appends rows whose key a Parquet table lacks, in rounds of batches, and numbers them: (round, ..., columns).

    The table itself is the memory, so no state grows: a round joins its rows' keys with the table's (only the key
    column is read). A round has ``rows_per_round`` new rows at most; a batch's rows are numbered in order of the key and all its
    rounds are written at once. A batch that runs again after a failure finds its own rows in the table and
    adds none twice. One writer at a time: two that insert the same key at once could both."""
    spark = stream.sparkSession

    def rounds(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates([key])
        try:
            old = spark.read.parquet(table)
            found, last = old.select(F.col(key).alias("_old")), old.agg(F.max("round")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            found, last = None, None
        absent = rows if found is None else rows.join(found, rows[key].eqNullSafe(found["_old"]), "left_anti")
        place = numbered_rows(absent, [F.col(key)], "_place")
        new = place.select(*batch.columns, (F.floor(F.col("_place") / rows_per_round) + (last or 0) + 1).cast("long").alias("round"))
        if not new.isEmpty():
            new.write.mode("append").parquet(table)

    stream.writeStream.foreachBatch(rounds).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _streamed(df: DataFrame, label: str) -> DataFrame:
    """A table written to the shared folder, as a stream of one batch."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return file_stream(df.sparkSession, path, df.schema, 1_000_000)


_FLUSH_ROWS, _SLOTS, _ROUND = 100, 4, 1000


@register("stream_buffered_writer", f"""
WITH e AS (SELECT coalesce(event_type, '') AS writer, event_id % {_SLOTS} AS slot, event_id AS seq, props AS payload,
             row_number() OVER (PARTITION BY coalesce(event_type, ''), event_id % {_SLOTS} ORDER BY event_id) - 1 AS k FROM events)
SELECT writer, slot, k // {_FLUSH_ROWS} AS flush, CASE WHEN count(*) OVER (PARTITION BY writer, slot, k // {_FLUSH_ROWS}) = {_FLUSH_ROWS} THEN 'rows' ELSE 'flush' END AS cause,
       k % {_FLUSH_ROWS} AS place, seq, 'add' AS op, payload FROM e""")
def stream_buffered_writer(spark, sf_dir):
    """All events through buffers of a hundred rows by type, four for each type, which a last row of each flushes."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.coalesce("event_type", F.lit("")).alias("writer"), F.col("event_id").alias("seq"), F.lit("add").alias("op"), F.col("props").cast("string").alias("payload"))
    last = F.explode(F.sequence(F.lit(2**63 - _SLOTS), F.lit(2**63 - 1)))
    ends = rows.select("writer").distinct().select("writer", last.alias("seq"), F.lit(FLUSH).alias("op"), F.lit(None).cast("string").alias("payload"))
    return run_to_table(buffered(_streamed(rows.unionByName(ends), "written"), max_rows=_FLUSH_ROWS, slots=_SLOTS), spark, "append", "flushes")


@register("stream_insert_rounds", f"SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1) // {_ROUND} + 1 AS round FROM (SELECT DISTINCT user_id FROM events)")
def stream_insert_rounds(spark, sf_dir):
    """Users as they are inserted where absent, a thousand in a round."""
    table = shared_path(spark, "rounds")
    stream = _streamed(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id"), "users")
    insert_rounds(stream, table, "user_id", shared_path(spark, "rounds-state"), _ROUND)
    return spark.read.parquet(table)
