"""Operator 5: Lempel-Ziv phrase fingerprints.

A text is parsed into the phrases of an LZ78 dictionary; each phrase is hashed, and the smallest
hashes of the phrase set are the fingerprint (published as the Lempel-Ziv Jaccard distance). Texts
that compress alike share phrases, and the share of common smallest hashes estimates how many.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Hashes in a fingerprint; characters of text in a block of neighbouring documents, on average.
SIZE, BLOCK_CHARS = 128, 128_000_000
_FACTOR = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def parse(text: str, phrases: dict[str, None], rest: str = "") -> str:
    """Adds the LZ78 phrases of a text, in their order, and returns what has not become a phrase."""
    for c in text:
        rest += c
        if rest not in phrases:
            phrases[rest] = None
            rest = ""
    return rest


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's factor and of its inverse modulo 2**64, ``n`` at least."""
    size = max(4096, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        inverse = pow(_FACTOR, -1, 1 << 64)
        up, down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, f, np.uint64)))) for f in (_FACTOR, inverse))
        if len(_POWERS) > 8:
            _POWERS.clear()
        _POWERS[size] = (up, down)
    return _POWERS[size]


def fingerprint(text: str, phrases: dict[str, None]) -> np.ndarray:
    """The smallest hashes of the phrases, which follow each other from the start of ``text``."""
    if not phrases:
        return np.zeros(0, "<u4")
    ends = np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))
    codes = np.frombuffer(text[: int(ends[-1])].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    up, down = _powers(len(codes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)])))
    starts = np.concatenate(([0], ends[:-1]))
    mixed = (sums[ends] - sums[starts]) * down[starts]
    mixed = mix(mixed)
    return np.unique(np.sort((mixed >> np.uint64(32)).astype("<u4")))[:SIZE] if len(mixed) <= 4 * SIZE else np.unique(np.partition((mixed >> np.uint64(32)).astype("<u4"), 2 * SIZE)[: 2 * SIZE])[:SIZE]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of both sets that both hold; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    least = np.union1d(a, b)[:SIZE]
    return float(np.count_nonzero(both <= least[-1])) / len(least)


def encoded(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode()


def decoded(fingerprint_text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint_text), "<u4")


def edited_text(text: str, following: str) -> str:
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def _both(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of a text and of its edited text, whose common start is parsed once."""
    m = len(text) // 3
    own: dict[str, None] = {}
    rest = parse(text[: len(text) - m], own)
    other = own.copy()
    parse(text[len(text) - m :], own, rest)
    parse(following[:m], other, rest)
    edited = edited_text(text, following)
    return fingerprint(text, own), fingerprint(edited, other), edited


def _cuts(rows: DataFrame, block_chars: int) -> tuple[int, list[tuple[bool, int, int]]]:
    """Blocks, and the place (is null, ~id, hash) where each but the first begins, in descending id order.

    An id that fills several blocks, and the null ids, are cut by a hash of the texts. There are as
    many cuts as blocks, each of which is a partition."""
    chars, total, known = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*"), F.count("doc_id")).first()
    n = max(1, min(total, max(common.shuffle_partitions(rows.sparkSession), -(-int(chars) // block_chars))))
    of_nulls = -(-n * (total - known) // max(1, total))
    steps = [i / (n - of_nulls) for i in range(1, n - of_nulls)]
    found = (rows.select(F.percentile_approx("doc_id", steps, 10 * n)).first()[0] or []) if steps else []
    parts = lambda m: [-(1 << 63) + j * ((1 << 64) // m) for j in range(m)]
    cuts = [(False, ~i, h) for i, m in Counter(found).items() for h in parts(m)]
    return n, sorted(cuts) + [(True, 0, h) for h in (parts(of_nulls) if of_nulls else [])]


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, edited (the text).

    The next document has the next smaller id; after the smallest comes the largest. A null text is
    empty, its fingerprint is "" and its likeness to another empty one 1. Null ids come last. Rows with
    one id follow in the order of a hash of their texts where they fill more than one block, else of
    their texts. Other columns are not read. A single row is its own next one. An empty table gives an
    empty table.

    A block of neighbouring ids is one sorted partition, read as a stream that holds two texts; the
    first document of each block is sent to the block before it as well."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, cuts = _cuts(rows, block_chars)
    split = len({c[:2] for c in cuts}) < len(cuts)
    keyed = rows.select(F.isnull("doc_id").alias("no_id"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("back"), (F.xxhash64("text") if split else F.lit(0).cast("long")).alias("h"), "doc_id", "text")
    sent = spark.sparkContext.broadcast(cuts)

    def places(batch: pa.RecordBatch) -> list[tuple[bool, int, int]]:
        return [*zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bisect.bisect_right(sent.value, p) for p in places(batch)], pa.int32()), *batch.columns], names=["block", "no_id", "back", "h"])

    least = keyed.select("no_id", "back", "h").mapInArrow(blocks, "block int, no_id boolean, back long, h long").groupBy("block").agg(F.min(F.struct("no_id", "back", "h")).alias("head"))
    heads = sorted((r.block, tuple(r.head)) for r in least.collect())
    #: where a block begins: the block that ends before it
    first_of = spark.sparkContext.broadcast({head: heads[k - 1][0] for k, (_, head) in enumerate(heads)})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(batch)
            again = [k for k, p in enumerate(at) if p in first_of.value]
            to = [bisect.bisect_right(sent.value, p) for p in at] + [first_of.value[at[k]] for k in again]
            every = pa.array([*range(len(at)), *again])
            extra = [False] * len(at) + [True] * len(again)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(extra), *(c.take(every) for c in batch.columns)], names=["block", "follows", *batch.schema.names])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits: tuple | None = None  # the row before, which needs the text of the next
        open_: tuple | None = None  # the row before that, which needs the fingerprint of the next
        ended = None  # the block whose end has been seen
        for batch in batches:
            out: list[tuple] = []
            for block, follows, i, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if follows and block == ended:
                    continue
                if waits is not None:
                    mine, other, edited = _both(waits[1], text)
                    if open_ is not None:
                        out.append((*open_[:-1], likeness(open_[-1], mine)))
                    open_ = (edited, waits[0], len(waits[1]), hashlib.sha256(edited.encode()).hexdigest(), encoded(mine), encoded(other), likeness(mine, other), mine)
                waits = (i, text)
                if follows:
                    phrases: dict[str, None] = {}
                    parse(text, phrases)
                    out.append((*open_[:-1], likeness(open_[-1], fingerprint(text, phrases))))
                    waits, open_, ended = None, None, block
            edited, *columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*columns, edited), TYPES, strict=True)], names=NAMES)

    moved = keyed.mapInArrow(dealt, "block int, follows boolean, no_id boolean, back long, h long, doc_id long, text string").repartitionById(n, "block")
    return moved.sortWithinPartitions("block", "follows", "no_id", "back", "h", "text").select("block", "follows", "doc_id", "text").mapInArrow(compared, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]


def op5_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(common.table(spark, sf_dir, "documents")).drop("edited")
