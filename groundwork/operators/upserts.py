"""A table that updates touch in part: rows by buckets of their key, each bucket written anew as a whole.

The rows of bucket b that commit n wrote stand in ``data/<n>/bucket=<b>``; ``commits`` says, a row each,
which buckets a commit wrote, and is appended to last, in one file, which Spark renames into place
when it is whole. What a bucket holds is what its last commit wrote. So an update reads and writes the
buckets of its own keys only, files of all others stay as they are, and a writer that is lost before
its commit leaves the table as it was; its rows are written over by the next. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators.latest import upsert_latest

BUCKETS = 64


def _bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _written(spark: SparkSession, root: str) -> dict[int, int]:
    """The last commit of each bucket; at most as many rows as there are buckets."""
    rows = spark.read.schema("commit long, bucket int").parquet(f"{root}/commits").groupBy("bucket").agg(F.max("commit").alias("commit"))
    return {r["bucket"]: r["commit"] for r in rows.collect()}


def _rows(spark: SparkSession, root: str, schema, at: dict[int, int]) -> DataFrame:
    paths = [f"{root}/data/{n}/bucket={b}" for b, n in sorted(at.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _commit(df: DataFrame, root: str, n: int, touched: Sequence[int]) -> None:
    df.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/{n}")
    marks = df.sparkSession.createDataFrame([(n, b) for b in touched], "commit long, bucket int")
    marks.coalesce(1).write.mode("append").parquet(f"{root}/commits")


def create(df: DataFrame, root: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """The table with the rows of ``df``, one for each key."""
    rows = _bucketed(df, keys, buckets).repartition("bucket")
    held = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
    _commit(rows, root, 0, held)


def current(spark: SparkSession, root: str, schema) -> DataFrame:
    """The rows of the table, of ``schema``."""
    return _rows(spark, root, schema, _written(spark, root))


def upsert(updates: DataFrame, root: str, keys: Sequence[str], order: Sequence[Column], buckets: int = BUCKETS) -> list[int]:
    """Puts ``updates`` over the table: of the rows of a key, old and new, the first in ``order`` stays.
    Returns the buckets that were written. ``buckets`` is that of the table."""
    spark, at = updates.sparkSession, _written(updates.sparkSession, root)
    new = _bucketed(updates, keys, buckets)
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
    if touched:
        old = _rows(spark, root, updates.schema, {b: n for b, n in at.items() if b in set(touched)})
        rows = upsert_latest(_bucketed(old, keys, buckets), new, ["bucket", *keys], order)
        _commit(rows.repartition("bucket"), root, 1 + max(at.values(), default=-1), touched)
    return touched
