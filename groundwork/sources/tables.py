"""Readers of the driver-style table folder (one Parquet table per name)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``, read through Spark so that any store works."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
