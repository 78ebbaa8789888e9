"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a directory; columns are pruned and filters pushed by the optimizer."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
