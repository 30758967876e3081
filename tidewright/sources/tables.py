"""Loaders for the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table `name` under the folder `base`."""
    return spark.read.parquet(f"{base}/{name}.parquet")
