"""Corpus pipeline: documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm.line_dedup import dedup_lines
from tillroll.llm.mixing import mix_documents
from tillroll.llm.packing import pack
from tillroll.llm.pu_quality import scored, train
from tillroll.llm.setsketch import keep_one_per_group
from tillroll.llm.store import materialize
from tillroll.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Packing and the exact set arithmetic of near-dedup are not SQL; the tests
# compare each stage with a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = train(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))
    return scored(docs, model).filter("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which nothing is left."""
    cleaned = dedup_lines(docs)
    return cleaned.filter(r"removed_lines = 0 or text rlike '[^\\x20\\x09-\\x0D]'").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one_per_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1,024 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
