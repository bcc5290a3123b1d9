"""Rows kept by order: upserts, first and latest rows, keys, paging."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``; Spark limits groups before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def upsert_latest(base: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``base`` with ``updates`` over it: per key the first row in ``order``."""
    return top_per(base.unionByName(updates), keys, order)


def insert_ignore(base: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``base`` with the rows whose keys it lacks; of several such rows the first in ``order``."""
    return base.unionByName(top_per(rows, keys, order).join(base.select(*keys).distinct(), list(keys), "left_anti").select(*base.columns))


def latest_revision(runs: DataFrame, thread: str = "thread_key", revision: str = "revision") -> DataFrame:
    return top_per(runs, [thread], [F.col(revision).desc()])


def next_per_lane(runs: DataFrame, now: Column, lane: str = "lane") -> DataFrame:
    """The oldest run of each lane that is queued or publishing and ready."""
    ready = runs.filter(F.col("status").isin("queued", "publishing") & (F.col("ready_at") <= now))
    return top_per(ready, [lane], [F.col("created_at"), F.col("id")])


def outbox_page(notices: DataFrame, now: Column, size: int = 30) -> DataFrame:
    """Unsent, unblocked and due notices, the first ``size`` by id."""
    return notices.filter(F.col("sent_at").isNull() & F.col("blocked_reason").isNull() & (F.col("due_at") <= now)).orderBy("id").limit(size)


def audit_rows(log: DataFrame, order: str, n: int) -> DataFrame:
    """The latest ``n`` (1 to 100) rows."""
    return log.orderBy(F.col(order).desc()).limit(max(1, min(100, n)))


def duplicate_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of ``child`` without a row of ``parent``; null references count as none."""
    p = parent.select(*[F.col(b).alias(f"_p_{b}") for _, b in on]).distinct()
    return child.join(p, [child[a] == p[f"_p_{b}"] for a, b in on], "left_anti")


def fingerprint(*cols: str) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]), 256)


def reuse_by_fingerprint(work: DataFrame, cache: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``work`` with its fingerprint over ``cols`` and whether ``cache`` (fingerprint) holds it."""
    known = cache.select("fingerprint", F.lit(True).alias("hit")).distinct()
    return work.withColumn("fingerprint", fingerprint(*cols)).join(known, "fingerprint", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def audit_transitions(log: DataFrame, allowed: DataFrame, key: str, order: Sequence[str], status: str) -> DataFrame:
    """Status changes of each key, in order, that ``allowed`` (from_status, to_status) lacks."""
    w = W.partitionBy(key).orderBy(*order)
    steps = log.withColumn("from_status", F.lag(status).over(w)).withColumn("to_status", F.col(status)).filter("from_status is not null")
    return steps.join(allowed, ["from_status", "to_status"], "left_anti")


def carried(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, start: Callable[[], Any], step: Callable[[Any, Any], tuple[Any, tuple]], made: str) -> DataFrame:
    """``rows`` with the columns ``made``: ``step`` takes what is carried and the next value of a
    key, in ``order``, and gives what is carried on and the row's new values; each key begins with
    ``start``. A key's rows stand in a row of one partition and pass in bounded batches."""
    new = T.StructType.fromDDL(made)
    kinds = [{"boolean": pa.bool_(), "long": pa.int64(), "bigint": pa.int64()}[f.dataType.simpleString()] for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start()
        for b in batches:
            out = []
            at = zip(*(b.column(k).to_pylist() for k in keys), strict=True)
            for key, v in zip(at, b.column(value).to_pylist(), strict=True):
                if last is None or any(x != y and (x == x or y == y) for x, y in zip(key, last, strict=True)):
                    last, state = key, start()
                state, given = step(state, v)
                out.append(given)
            cols = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *new.names])

    ranked = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ranked.mapInArrow(run, T.StructType([*rows.schema.fields, *new.fields]))
