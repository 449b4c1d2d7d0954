"""Queries of the general data problems: timestamps and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import split_packed
from ..operators.timestamps import normalise_timestamps
from ..sources.tables import table
from .core_sql import P5, P5_STATUS, P6, P6_SPLIT


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = normalise_timestamps(table(spark, d, "evidence_items").select("row_id", "published_at", "source"), table(spark, d, "news_sources"))
    return out.where("instant_us is not null").select("row_id", F.col("instant_us").alias("published_us"))


def p5_status(spark: SparkSession, d: str) -> DataFrame:
    """Values per outcome of the cascade."""
    out = normalise_timestamps(table(spark, d, "evidence_items").select("row_id", "published_at", "source"), table(spark, d, "news_sources"))
    return out.groupBy("instant_status").agg(F.count("*").alias("n_values"))


def p6_split(spark: SparkSession, d: str) -> DataFrame:
    runs = split_packed(table(spark, d, "labeled_runs"), "run_id", ["golden_memory_session_ids", "golden_document_urls"], "arrived_at")
    questions = split_packed(table(spark, d, "experiment_questions"), "question_idx", ["evidence_list", "memory_evidence"], "arrived_at")
    return runs.unionByName(questions)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_split(spark, d).select("record_id", "field_name", "pos", "item")


QUERIES = {f.__name__: f for f in (p5_found, p5_status, p6_found, p6_split)}
SQL = {"p5_found": P5, "p5_status": P5_STATUS, "p6_found": P6, "p6_split": P6_SPLIT}
