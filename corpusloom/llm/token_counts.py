"""Operator 4: tokens of every text without a shuffle of pre-tokens.

A sentence-piece text falls into chunks that no piece crosses: a run of spaces with the word behind
it, and each newline. A first pass keeps a bounded table of frequent chunks in each task and sums
the tables; the most frequent chunks with their lengths become a small broadcast table. In the
second pass each worker adds chunk lengths up, first from that table, then from its own cache,
which the library fills.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common

CHUNK = re.compile(r"\n| *[^ \n]+| +")
#: Longest chunk in the broadcast table, chunks a task reports, chunks in the table: at most 16384 x 256 bytes.
HOT_CHARS, TASK_CHUNKS, HOT_CHUNKS = 64, 4096, 16384


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chunks(text: str) -> list[str]:
    """Chunks of a text with the space that the library puts before it; a written U+2581 is a space to it."""
    return CHUNK.findall(" " + text.replace("▁", " ")) if text else []


def chunk_lengths(model: sentencepiece.SentencePieceProcessor, found: list[str]) -> list[int]:
    """Pieces of each chunk inside a text. A newline is always one piece, so it fences a chunk off;
    the library's own space stands for a chunk's first."""
    fenced = [c[1:] + "\n" if c[0] == " " else "\n" + c for c in found]
    return [1 if c == "\n" else len(ids) - (1 if c[0] == " " else 2) for c, ids in zip(found, model.encode(fenced, num_threads=1), strict=True)]


class Lengths:
    """Two tiers: the broadcast table, then what this worker has encoded, dropped when it grows past ``most``."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, hot: dict[str, int], most: int = 500_000):
        self.model, self.hot, self.now, self.most = model, hot, dict(hot), most

    def counts(self, texts: list[str], at_once: int = 2_000_000) -> list[int]:
        """Tokens of each text; misses of about ``at_once`` characters are encoded together."""
        out, held, chars = [], [], 0
        for text in texts:
            held.append(chunks(text))
            chars += len(text)
            if chars >= at_once:
                out += self._sums(held)
                held, chars = [], 0
        return out + self._sums(held)

    def _sums(self, held: list[list[str]]) -> list[int]:
        missing = [*set().union(*held).difference(self.now)]
        if len(self.now) + len(missing) > self.most:
            self.now = dict(self.hot)
            missing = [*set().union(*held).difference(self.now)]
        self.now.update(zip(missing, chunk_lengths(self.model, missing), strict=True))
        return [sum(map(self.now.__getitem__, x)) for x in held]


def _lengths(path: str, tag: str, hot: dict[str, int]) -> Lengths:
    """The cache of this worker process, kept from task to task of one run."""
    return common.held_by_worker(("lengths", path, tag), lambda: Lengths(sentencepiece.SentencePieceProcessor(model_file=path), hot))


def frequent_chunks(docs: DataFrame, text_col: str = "text", most: int = HOT_CHUNKS) -> list[str]:
    """The most frequent chunks of all texts (a hint for speed only; results don't depend on it).

    Each task drops its rarest chunks whenever its table is full and reports TASK_CHUNKS at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in common.as_texts(batch.column(0)):
                seen.update(chunks(text))
                if len(seen) > 32 * TASK_CHUNKS:
                    seen = Counter(dict(seen.most_common(8 * TASK_CHUNKS)))
        top = [(k, n) for k, n in seen.most_common(TASK_CHUNKS) if len(k) <= HOT_CHARS and n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["chunk", "n"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(counted, "chunk string, n long")
    return [r.chunk for r in found.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(most).collect()]


def count_tokens(docs: DataFrame, limit: int = 4096, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens (long), over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids stay as they are;
    other columns are not read. An empty table gives an empty table."""
    spark, path = docs.sparkSession, model_file or model_path()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    frequent = frequent_chunks(docs, text_col)
    hot = spark.sparkContext.broadcast(dict(zip(frequent, chunk_lengths(model, frequent), strict=True)))
    tag = common.uuid.uuid4().hex

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(path, tag, hot.value)
        for batch in batches:
            n = lengths.counts(common.as_texts(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(counted, out)
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
