"""Documents to token ids in five stages; each is written as Parquet and read again by the next.

Every stage but the last returns the columns of its documents and no others, in their order. Extra columns
of any name pass through, but for the names that a stage's operator adds (its docstring names them), which
must not be among them. Null and empty texts stay rows; repeated rows are rows of their own unless a stage
says otherwise; empty tables of documents, labels or benchmark items are fine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common, decontaminate, line_dedup, near_dedup, piece_codec, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 (a score of 0.7 goes). A null text scores as an empty one."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("toxic_score < 0.7").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document of smaller id holds; n_chars follows the text. Rows of one
    id count as one document, a null id takes no part, a null text becomes empty."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate class, with all rows of that id; rows with a null id stay."""
    gone = near_dedup.near_duplicates(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item, each row by itself; null and empty texts stay."""
    return decontaminate.without_benchmark(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids and what decoding them gives."""
    return piece_codec.encode_texts(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", drop_benchmark),
    ("sentence_pieces", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
