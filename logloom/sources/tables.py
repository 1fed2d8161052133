"""The Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; its columns are pruned and its filters pushed down by the reader."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
