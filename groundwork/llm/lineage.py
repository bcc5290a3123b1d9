"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session names it. Where none is named, a folder of our own serves a
    local session (tests); on a cluster that would not be shared, so it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder, so that a lost executor costs no
    more than a reread. spark.cleaner.referenceTracking.cleanCheckpoints, set by the session, lets
    Spark delete what no DataFrame refers to any more."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
