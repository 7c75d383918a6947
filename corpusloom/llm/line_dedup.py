"""Operator 9: drop lines that other documents hold.

Lines are exploded to 16-byte hashes of their keys, which are written once; documents are counted
per hash, and each document with something to drop gets the hashes of those keys back; its lines
are then put together again in their order. Line texts are never shuffled, only hashes; the texts
move once, for the join that brings the hashes back. Hashes that many lines have are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common


def line_key(line: bytes) -> bytes:
    """The line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased (both as bytes do it)."""
    return line.strip().lower()


def _counts(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` with the kept lines as ``text_col``, then n_lines and n_dropped (long).

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents loses all
    its lines except in the smallest id that holds it. A null text is one empty line and becomes "".
    Rows that share an id count as one document. A row with a null id takes no part: it keeps all
    lines and counts for nothing. Columns named n_lines or n_dropped (in any case, where Spark ignores
    it) are replaced. An empty table gives an empty table."""

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
                found = {xxhash.xxh3_128_digest(k) for line in text.split(b"\n") if _counts(k := line_key(line), min_chars)}
                keys += found
                ids += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(keys, pa.binary())], names=["_line_doc", "_line_key"])

    id_type = docs.schema[id_col].dataType
    known = docs.where(F.col(id_col).isNotNull()).select(id_col, F.col(text_col).cast("string").alias("_line_text"))
    lines = known.mapInArrow(common.tidy(keys_of), T.StructType([T.StructField("_line_doc", id_type), T.StructField("_line_key", T.BinaryType())]))
    lines = common.written(lines, "line-keys")
    per_key = lines.groupBy("_line_key").agg(F.min("_line_doc").alias("_line_first"), F.max("_line_doc").alias("_line_last"), F.count("*").alias("_line_rows")).where("_line_first < _line_last")
    if min_docs > 2:
        documents = lines.groupBy("_line_key", "_line_doc").agg(F.lit(1).alias("_one")).groupBy("_line_key").count().where(F.col("count") >= min_docs)
        per_key = per_key.join(documents.select("_line_key"), "_line_key")
    shared = common.written(per_key.drop("_line_last"), "shared-lines")
    lost = common.join_evenly(lines, shared, ["_line_key"], "_line_rows").where("_line_doc > _line_first").groupBy("_line_doc").agg(F.collect_set("_line_key").alias("_line_lost"))

    kept = common.fields_without(docs, ["n_lines", "n_dropped"])
    out = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in kept] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at = [f.name for f in kept].index(text_col)

    def reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            for text, lost_keys in zip(common.as_bytes(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                all_lines = text.split(b"\n")
                total.append(len(all_lines))
                if lost_keys:
                    drop = set(lost_keys)
                    left = [x for x in all_lines if not (_counts(k := line_key(x), min_chars) and xxhash.xxh3_128_digest(k) in drop)]
                    gone.append(len(all_lines) - len(left))
                    text = b"\n".join(left)
                else:
                    gone.append(0)
                texts.append(text)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=out.names)

    base = docs.select(*[f"`{f.name}`" for f in kept]).withColumn(text_col, F.col(text_col).cast("string"))
    joined = base.join(lost, base[id_col] == lost["_line_doc"], "left").drop("_line_doc")
    return joined.mapInArrow(common.tidy(reassembled), out)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM doc),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line),
first AS (SELECT key, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS n FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id > f.first_doc AS dropped FROM keyed k LEFT JOIN first f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
