"""Parquet tables of one dataset directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` of the directory ``root`` (one file or a folder of files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")
