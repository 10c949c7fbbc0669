"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a data folder, lazily; column pruning and filters reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
