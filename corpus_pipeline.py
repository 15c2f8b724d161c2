"""Corpus pipeline: stages over the documents table, each written as Parquet and read again.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame
that is the next stage's ``docs``. All but the last return the columns of documents; the last
returns the packed pieces.

Null or empty texts are rejected by the quality rules; a document that loses all its lines
stays with empty text; extra columns are carried; an empty table runs through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelset.llm import decontaminate, jaccard_join, line_dedup, packing, quality_rules
from labelset.llm.queries import LLM_QUERIES, Query, table, vocabulary
from labelset.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy does not reject."""
    led = quality_rules.ledger(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text")))
    return quality_rules.apply_policy(led).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that came earlier; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    if "n_lines_removed" not in docs.columns:
        out = out.drop("n_lines_removed")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id."""
    later = jaccard_join.near_duplicates(docs).where("class_id <> doc_id").select(F.col("doc_id").alias("_later")).distinct()
    return docs.join(later, docs["doc_id"] == later["_later"], "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: Near-duplicate classes, edit matching and tokenisation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result goes through Parquet in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    home = scratch_path(spark, f"corpus-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{home}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def pipeline_queries() -> dict[str, Query]:
    """Every query of the corpus operators and of this pipeline."""
    return {**LLM_QUERIES, "pipeline": Query("pipeline", run, ORACLE_SQL)}
