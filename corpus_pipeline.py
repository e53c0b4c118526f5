"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Toxic documents go; repeated long lines go; one document of each group of near
duplicates stays; documents that hold a benchmark passage go; the rest is packed
into sequences.  Every stage works on all rows that the stage before it kept, and
all but the last return the columns of ``documents``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneta.llm.common import read, written
from moneta.llm.decontam import decontaminate
from moneta.llm.line_dedup import dedup_lines
from moneta.llm.minhash import near_duplicates
from moneta.llm.packing import pack_documents
from moneta.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar doesn't call toxic (score below 0.5)."""
    out = score_toxicity(docs, read(spark, sf_dir, "labels"))
    return out.where("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated long lines that a larger doc_id keeps; n_chars follows the text."""
    out = dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    n_chars = F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates; one of identical rows."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark passage."""
    hit = decontaminate(docs, read(spark, sf_dir, "benchmark")).where("n_hit > 0").select(
        F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_row")), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents in sequences of 2048 ids."""
    import public_tokenizers
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages are learned or iterative; tests/llm/test_pipeline_plain.py holds the run against a plain version of each.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
