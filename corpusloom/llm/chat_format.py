"""Operator 13: final conversations out of logs of what happened to them, rendered for training.

A log has one row for each event: a message is opened, text streams in, a text is edited, a message
is generated again (which throws away its text and all later messages). Events are dealt out by ranges of
conversation and sequence, sorted, and folded as a stream. A conversation that lies in one task is
rendered there. One that is cut between tasks, because it has very many events, leaves a partial
message for each message and task; partial messages add up, so they are put together message by
message, and no task gets the whole conversation.

The template marks each turn; control strings inside texts get a backslash behind their first
character (one more than they have), so a rendered text has none of its own, and taking one away
gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common

OPEN, DELTA, EDIT, AGAIN = "open", "delta", "edit", "again"
BEGIN, END, LEARNT = "<|im_start|>", "<|im_end|>\n", "assistant"
#: What no text may hold for itself: marks of this and of other templates, as fixed strings.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_PLAIN = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROLS))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROLS))
#: A row of the output ends after so many characters; a longer turn stays whole.
BLOCK_CHARS = 1_000_000


def escaped(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def escaped_role(role: str) -> str:
    """One line: backslashes are doubled and ends of lines written as \\n, before controls are escaped."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn, where the text under the loss mask begins in it, and how long that is (0: none)."""
    head, body = f"{BEGIN}{escaped_role(role)}\n", escaped(text)
    return head + body + END, len(head), len(body) if role == LEARNT else 0


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a rendered conversation."""
    out = []
    for turn in formatted.split(BEGIN)[1:]:
        role, text = turn.split("\n", 1)
        out.append((unescaped_role(role), unescaped(text[: -len(END)])))
    return out


class Stretch:
    """What a stretch of a conversation's events says: for each message it touches whether it was opened
    (and its role), whether earlier text is void, and the text since; and the least message generated again."""

    def __init__(self) -> None:
        self.messages: dict[Any, list] = {}  # message -> [opened, role, void, texts]
        self.least: Any = None

    def add(self, kind: str, message: Any, role: str | None, text: str | None) -> None:
        if message is None:
            return
        if kind == OPEN:
            self.messages[message] = [True, role or "", True, [text or ""]]
        elif kind == DELTA:
            self.messages.setdefault(message, [False, None, False, []])[3].append(text or "")
        elif kind == EDIT:
            self.messages.setdefault(message, [False, None, True, []])[2:] = True, [text or ""]
        elif kind == AGAIN:
            for later in [m for m in self.messages if m > message]:
                del self.messages[later]
            self.messages.setdefault(message, [False, None, True, []])[2:] = True, []
            self.least = message if self.least is None else min(self.least, message)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def _blocks(turns: list[tuple[Any, str, str]]) -> list[tuple[Any, int, str, list]]:
    """(first message, turns, formatted, loss spans) of (message, role, text) in order."""
    out: list[tuple[Any, int, str, list]] = []
    first, texts, spans, size = None, [], [], 0
    for message, role, text in turns:
        turn, begin, length = rendered(role, text)
        if texts and size + len(turn) > BLOCK_CHARS:
            out.append((first, len(texts), "".join(texts), spans))
            first, texts, spans, size = None, [], [], 0
        first = message if first is None else first
        if length:
            spans.append({"start": size + begin, "length": length})
        texts.append(turn)
        size += len(turn)
    if texts:
        out.append((first, len(texts), "".join(texts), spans))
    return out


def format_chats(log: DataFrame) -> DataFrame:
    """Rendered conversations in rows (conv_id, at, single, n_turns, formatted, loss): the blocks of a conversation,
    in the order of ``at``, are its text; loss has the places (start from 0, length, in code points of
    ``formatted``) of what is learnt, the assistants' texts. single: the conversation has no other block.

    log: conv_id, seq, kind, message, role, text; other columns are ignored. seq and message can be of any
    type that has an order; messages of a conversation stand in the order of ``message``. "open" begins a
    message with a role and a text (one that is open begins anew), "delta" adds to its text, "edit"
    replaces it, "again" empties it and drops the conversation's messages after it. Events for a message
    that isn't open are void, but "again" drops later messages even so; so are events of another kind or
    without a message. Null roles and texts are empty. Events of equal seq stand by message,
    kind and text; repeated events happen repeatedly. A null conv_id is a conversation like others.
    A conversation without a message in the end has no row; an empty log has none.

    The rows are those of two tables written to the shared folder."""
    spark = log.sparkSession
    of = {f.name: f.dataType for f in log.select("conv_id", "seq", "message").schema.fields}
    order = ["conv_id", "seq", "message", "kind", "text"]
    events = log.select("conv_id", "seq", "message", F.col("kind").cast("string").alias("kind"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    events = events.repartitionByRange(common.shuffle_partitions(spark), "conv_id", "seq").sortWithinPartitions(*order)
    block = [T.StructField("conv_id", of["conv_id"]), T.StructField("at", of["message"]), T.StructField("single", T.BooleanType()), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss", SPANS)]
    partial = [T.StructField("stretch", T.LongType()), T.StructField("opened", T.BooleanType()), T.StructField("role", T.StringType()), T.StructField("void", T.BooleanType()), T.StructField("least", of["message"])]
    schema = T.StructType(block + partial)
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema.fields])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        size = 0

        def close(conv: Any, stretch: Stretch, place: int, whole: bool) -> int:
            """Rows of one conversation's stretch; their characters. place: 0 for the task's first, 1 for its last."""
            if whole:
                found = _blocks([(m, role, "".join(texts)) for m, (opened, role, _, texts) in sorted(stretch.messages.items()) if opened])
                rows.extend((conv, at, len(found) == 1, n, text, loss, None, None, None, None, None) for at, n, text, loss in found)
                return sum(len(x[2]) for x in found)
            rows.append((conv, None, None, None, None, None, 2 * part + place, None, None, None, stretch.least))
            for m, (opened, role, void, texts) in stretch.messages.items():
                rows.append((conv, m, None, None, "".join(texts), None, 2 * part + place, opened, role, void, None))
            return sum(len(x) for m in stretch.messages.values() for x in m[3])

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

        held, stretch, first = None, None, True
        for b in batches:
            for conv, message, kind, role, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True):
                if stretch is None or conv != held:
                    if stretch is not None:
                        size += close(held, stretch, 0, not first)
                        first = False
                        if size > 8_000_000:
                            yield batch()
                            rows.clear()
                            size = 0
                    held, stretch = conv, Stretch()
                stretch.add(kind, message, role, text)
        if stretch is not None:
            close(held, stretch, 1 - first, False)
        yield batch()

    done = common.written(events.mapInArrow(folded, schema), "chats")
    # two rows for each task at most: its first and its last conversation
    marks = done.where("stretch is not null and opened is null").select("conv_id", "stretch", "least").orderBy("stretch").collect()
    later, held, least, of_stretch = None, object(), None, []
    for conv, stretch, cut in reversed(marks):
        later = None if conv != held else later if least is None else least if later is None else min(later, least)
        held, least = conv, cut
        of_stretch.append((stretch, later))
    cuts = spark.createDataFrame(of_stretch, T.StructType([T.StructField("stretch", T.LongType()), T.StructField("later", of["message"])]))
    parts = done.where("opened is not null").select("conv_id", "at", "stretch", "opened", "role", "void", F.col("formatted").alias("text"))
    alive = parts.join(F.broadcast(cuts), "stretch").where("later is null or at <= later")
    listed = alive.groupBy("conv_id", "at").agg(F.sort_array(F.collect_list(F.struct("stretch", "opened", "role", "void", "text"))).alias("parts"))

    def grown(x: Column, y: Column) -> Column:
        opened, role = x["opened"] | y["opened"], F.when(y["opened"], y["role"]).otherwise(x["role"])
        return F.struct(opened.alias("opened"), role.alias("role"), F.when(y["void"], y["text"]).otherwise(F.concat(x["text"], y["text"])).alias("text"))

    start = F.struct(F.lit(False).alias("opened"), F.lit(None).cast("string").alias("role"), F.lit("").alias("text"))
    whole = listed.select("conv_id", "at", F.aggregate("parts", start, grown).alias("m")).where("m.opened").select("conv_id", "at", "m.role", "m.text")
    out = T.StructType(block)
    merged_arrow = pa.schema(list(arrow)[: len(block)])

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(conv, at, False, *x[1:]) for conv, at, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in _blocks([(at, role, text)])]
            columns = list(zip(*rows, strict=True)) or [()] * len(merged_arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, merged_arrow.types, strict=True)], schema=merged_arrow)

    merged = common.written(whole.mapInArrow(shown, out), "chats-merged")
    return done.where("single is not null").select(*out.names).unionByName(merged)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


DIGESTS = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())]


def chat_digests(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) as read back from the rows of
    ``format_chats``: SHA-256 of role, \\n, text, \\n of each turn; code points and SHA-256 of all text under
    the loss mask, unescaped; code points of the rendered text.

    A conversation of one block is read where it lies; the blocks of others are sorted and read as a stream,
    one after the other, so no task holds more than a block. An empty table gives no rows."""
    out = T.StructType([chats.schema["conv_id"], *(T.StructField(*x) for x in DIGESTS)])
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in out.fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = None, None
        for b in batches:
            rows = []
            for conv, formatted, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv != held:
                    if now is not None:
                        rows.append((held, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4]))
                    held, now = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns_of(formatted):
                    now[0] += 1
                    now[1].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    learnt = unescaped(formatted[span["start"] : span["start"] + span["length"]])
                    now[2] += len(learnt)
                    now[3].update(learnt.encode())
                now[4] += len(formatted)
            yield _table(rows)
        if now is not None:
            yield _table([(held, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4])])

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    of = ["conv_id", "formatted", "loss"]
    alone = chats.where("single").select(*of).mapInArrow(read, out)
    several = chats.where(~F.col("single")).repartition(common.shuffle_partitions(chats.sparkSession), "conv_id").sortWithinPartitions("conv_id", "at")
    return alone.unionByName(several.select(*of).mapInArrow(read, out))


def log_of(conversations: DataFrame) -> DataFrame:
    """A log (conv_id, seq, kind, message, role, text) that leads to the given conversations: a message for each row,
    by ``turn`` (null first; equal turns by the md5 of role and text), whose text streams in. A third of the rows
    begin with a draft that is edited, a third with one that is generated again after a message followed it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.col("turn").cast("long")
    place = F.concat(F.when(turn.isNull(), "00").otherwise("01"), F.lpad(F.hex(F.coalesce(turn, F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    row = F.concat(place, F.substring(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")), 1, 16), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    rows = conversations.select("conv_id", role.alias("role"), text.alias("text"), row.alias("row"))
    rows = rows.withColumns({"pieces": F.pmod(F.length("text"), F.lit(3)) + 1, "way": F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(3))})
    size = (F.floor(F.length("text") / F.col("pieces")) + 1).cast("int")
    texts = F.transform(F.sequence(F.lit(0), (F.col("pieces") - 1).cast("int")), lambda k: F.substring("text", k * size + 1, size))
    draft = F.reverse(F.substring("text", 1, 24))

    def event(kind: str, text: Column, of: str = "") -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(of).alias("of"), text.alias("text"))

    streamed = F.transform(texts, lambda t: event(DELTA, t))
    plain = F.array(event(OPEN, F.lit("")))
    edited = F.array(event(OPEN, draft), event(EDIT, F.lit("")))
    anew = F.array(event(OPEN, F.lit("")), event(DELTA, draft), event(OPEN, draft, "01"), event(DELTA, F.lit("and more"), "01"), event(AGAIN, F.lit(None).cast("string")))
    events = F.concat(F.when(F.col("way") == 0, plain).when(F.col("way") == 1, edited).otherwise(anew), streamed)
    log = rows.select("conv_id", "role", "row", F.posexplode(events).alias("step", "e"))
    return log.select("conv_id", F.unhex(F.concat("row", F.lpad(F.hex("step"), 4, "0"))).alias("seq"), "e.kind", F.unhex(F.concat("row", "e.of")).alias("message"), F.when(F.col("e.kind") == OPEN, F.col("role")).alias("role"), "e.text")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    talks = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digests(format_chats(log_of(talks.unionByName(more))))
