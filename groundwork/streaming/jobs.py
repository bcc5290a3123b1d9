"""Streaming twins of the batch jobs: late rows, daily issues, debounce, versions, quotas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from groundwork.streaming.ordered import ordered_threads

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drop_late(stream: DataFrame, ts: str, received: str, limit: str = "5 minutes") -> DataFrame:
    """Rows received no later than ``limit`` after their time, under a watermark of ``limit``."""
    return stream.withWatermark(ts, limit).filter(F.col(received) <= F.col(ts) + F.expr(f"interval {limit}"))


def late_rows(stream: DataFrame, ts: str, received: str, limit: str = "5 minutes") -> DataFrame:
    """The rows that ``drop_late`` leaves out, for a side table."""
    return stream.filter(F.col(received) > F.col(ts) + F.expr(f"interval {limit}"))


def issue_windows(stream: DataFrame, ts: str, watermark: str = "1 hour") -> DataFrame:
    """issue_start, n: events of each daily issue, which begins at 01:00 UTC."""
    by = stream.withWatermark(ts, watermark).groupBy(F.window(ts, "1 day", "1 day", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("issue_start"), "n")


def debounce_revisions(stream: DataFrame, thread: str, ts: str, gap: str, watermark: str = "10 minutes") -> DataFrame:
    """thread, started, ready_at, n of each run of edits no further than ``gap`` apart."""
    by = stream.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), thread).agg(F.count("*").alias("n"))
    return by.select(thread, F.col("w.start").alias("started"), F.col("w.end").alias("ready_at"), "n")


def latest_messages(stream: DataFrame, delay: str = "1 minute") -> DataFrame:
    """(thread_key, ts, version, text): the messages of ``ordered_threads`` that are accepted: of a
    version higher than any before it of its ts, as message or as control message, and of new content."""
    return ordered_threads(stream, delay).filter("outcome = 'accepted'").select("thread_key", "ts", "version", "text")


def apply_controls(stream: DataFrame, delay: str = "1 minute") -> DataFrame:
    """(thread_key, ts, version, command, revision, outcome): the control messages of ``ordered_threads``."""
    return ordered_threads(stream, delay).filter("command in ('cancel', 'retry')").select("thread_key", "ts", "version", "command", "revision", "outcome")


def use_state_store(spark: SparkSession) -> None:
    """Keeps state in RocksDB, on disk with bounded memory, and checkpoints only its changes; keyed
    jobs with map state need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class _Quota(StatefulProcessor):
    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", T.StructType([T.StructField("used", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        used = self.used.get()[0] if self.used.exists() else 0
        # a key's rows of one micro-batch, which the source's rate limits, are served by arrival
        frames = list(rows)
        for f in [pd.concat(frames).sort_values("arrival", kind="stable")] if frames else []:
            allowed, after = [], []
            for n in f["units"]:
                ok = used + n <= self.limit
                used += int(n) if ok else 0
                allowed.append(ok)
                after.append(used)
            yield f.assign(allowed=allowed, used_after=after)
        self.used.update((int(used),))

    def close(self) -> None:
        pass


def quota_ledger_stream(stream: DataFrame, limit: int) -> DataFrame:
    """(provider, period, arrival, units): the quota ledger with its state kept across batches."""
    rows = stream.select("provider", "period", "arrival", "units")
    out = "provider string, period string, arrival long, units long, allowed boolean, used_after long"
    return rows.groupBy("provider", "period").transformWithStateInPandas(_Quota(limit), out, "append", "none")


def delivered_ledger(stream: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, event_id) of finished, live runs with a media id: a stream-static join."""
    done = runs.filter("status = 'done' and not dry_run and coalesce(media_id, '') <> ''").select(F.col("id").alias("run_id"))
    return stream.join(done, "run_id").select("run_id", "event_id")
