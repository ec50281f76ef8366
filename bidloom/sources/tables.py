"""Reading stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a directory; filters and column choices reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
