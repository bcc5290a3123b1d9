"""Keyed state over rows in the order of their time: threads of messages and controls, and an outbox.

A micro-batch gives a key's rows in whatever order the shuffle has. Here they wait in a buffer in
state, by their time, until the watermark has passed them; then they are applied in the order of their
time, equal times by all that the rows hold. So the outcome is the same for every order and every
division into micro-batches that the watermark allows, and a replayed row is applied once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Row = dict[str, Any]


class Ordered(StatefulProcessor):
    """Buffers rows and applies them by time. ``columns`` are those of a row, after its time ``at_ms``;
    ``out`` those of the result, after the key. Subclasses open their state, apply a row, and may say
    what falls due between rows."""

    columns: tuple[str, ...] = ()
    out: tuple[str, ...] = ()
    key_names: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "rows string")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Declares the state."""

    def apply(self, key: tuple, at: int, row: Row) -> Iterator[tuple]:
        """Results of a row whose turn it is."""
        raise NotImplementedError

    def due(self, key: tuple, before: int) -> Iterator[tuple]:
        """Results of what falls due before a time, earliest first."""
        return iter(())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for f in rows:
            new: dict[int, list[str]] = {}
            for at, *values in f[["at_ms", *self.columns]].itertuples(index=False):
                row = {c: None if v is None or v != v else v for c, v in zip(self.columns, values, strict=True)}
                new.setdefault(int(at), []).append(json.dumps(row, sort_keys=True, default=lambda v: v.item()))
            for at, texts in new.items():
                held = json.loads(self.waiting.getValue((at,))[0]) if self.waiting.containsKey((at,)) else []
                if not held:
                    self.handle.registerTimer(at)
                self.waiting.updateValue((at,), (json.dumps(sorted({*held, *texts})),))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs()
        out: list[tuple] = []
        for at in sorted(t for (t,) in self.waiting.keys() if t <= upto):  # noqa: SIM118
            out += self.due(key, at)
            for text in json.loads(self.waiting.getValue((at,))[0]):
                out += self.apply(key, at, json.loads(text))
            self.waiting.removeKey((at,))
        out += self.due(key, upto + 1)
        yield pd.DataFrame([(*key, *r) for r in out], columns=[*self.key_names, *self.out])

    def close(self) -> None:
        pass


def _rows(stream: DataFrame, at: str, delay: str, *columns: Any) -> DataFrame:
    """``columns`` of the stream and at_ms, its time in milliseconds, rounded up so that no row is
    taken before the watermark has passed it."""
    return stream.withWatermark(at, delay).select(at, F.expr(f"cast(ceil(unix_micros({at}) / 1000d) as bigint)").alias("at_ms"), *columns)


ACTIVE, REDONE, STATES = ("queued", "running", "needs_input"), ("failed", "needs_review"), ("running", "publishing", "needs_input", "needs_review", "failed", "done")


class _Threads(Ordered):
    """Per thread: its revision and status, the highest version of its messages and of its revision's
    controls; the last version and content of each message; the revision, version and command of each
    control message."""

    columns, key_names = ("ts", "version", "command", "text"), ("thread_key",)
    out = ("at_ms", "ts", "version", "command", "text", "revision", "outcome", "superseded")

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "revision int, status string, messages double, controls double")
        self.messages = handle.getMapState("messages", "ts string", "version double, digest string")
        self.controls = handle.getMapState("controls", "ts string", "revision int, version double, command string")

    def apply(self, key: tuple, at: int, row: Row) -> Iterator[tuple]:
        ts, version, command, text = row["ts"], row["version"], row["command"], row["text"]
        revision, status, messages, controls = self.now.get() if self.now.exists() else (0, "none", float("-inf"), float("-inf"))
        said = self.messages.getValue((ts,)) if self.messages.containsKey((ts,)) else None
        told = self.controls.getValue((ts,)) if self.controls.containsKey((ts,)) else None
        bound, superseded, outcome = revision, None, "ignored"
        if command in STATES:
            if revision:
                self.now.update((revision, command, messages, controls))
            return
        if version is None or (said and version <= said[0]) or (told and version <= told[1]):
            outcome = "duplicate"
        elif command == "message":
            digest = hashlib.sha256((text or "").encode()).hexdigest()
            if said and said[1] == digest:
                outcome = "duplicate"
                self.messages.updateValue((ts,), (version, digest))
                messages = max(messages, version)
            elif status == "publishing":
                outcome = "busy"
            else:
                self.messages.updateValue((ts,), (version, digest))
                superseded = revision if status in ACTIVE else None
                revision, status, messages, controls, outcome = revision + 1, "queued", max(messages, version), float("-inf"), "accepted"
                bound = revision
        elif command in ("cancel", "retry") and revision:
            bound = told[0] if told else revision
            seen = version < max(messages, controls) or (told is not None and told[2] == command)
            if bound == revision and not seen:
                if command == "cancel":
                    outcome = "rejected" if status == "publishing" else "applied" if status in ACTIVE else "ignored"
                    status = "cancelled" if outcome == "applied" else status
                else:
                    outcome = "applied" if status in REDONE else "rejected"
                    status = "queued" if outcome == "applied" else status
            self.controls.updateValue((ts,), (bound, version, command))
            controls = max(controls, version) if bound == revision else controls
        self.now.update((revision, status, messages, controls))
        yield (at, ts, version, command, text, bound, outcome, superseded)


def ordered_threads(stream: DataFrame, delay: str = "1 minute", at: str = "at") -> DataFrame:
    """(thread_key, at_ms, ts, version, command, text, revision, outcome, superseded) of each message
    and control message of a stream (thread_key, at, ts, version, command, text), in the order of
    ``at``, as the watermark of ``delay`` passes.

    command is ``message``, ``cancel``, ``retry``, or a status that the thread's run comes to. A message
    is a duplicate unless its version is higher than that of any message or control message of its ts
    and its content is new (equal content only advances the version); it is busy while the last
    revision is published; else it is accepted as a new revision, which supersedes an active one.

    A control message is a duplicate by the same rule. It is bound to the revision that was current when
    it first came, so that an edit or a replay never reaches a later one; it is ignored where it is
    older than the thread's messages or its revision's controls, repeats its command, or its revision is
    past. Cancel is applied to active runs and rejected while one is published, retry is applied to
    failed ones and else rejected. A row without a version is a duplicate; without a revision, controls
    are ignored."""
    rows = _rows(stream, at, delay, "thread_key", "ts", F.col("version").cast("double").alias("version"), "command", "text")
    out = "thread_key string, at_ms long, ts string, version double, command string, text string, revision int, outcome string, superseded int"
    return rows.groupBy("thread_key").transformWithStateInPandas(_Threads(), out, "append", "eventtime")


#: The status that a notice of a kind is of, by the kind up to a colon; progress is of two.
NOTICE_STATUS = {"done": ("done",), "failed": ("failed",), "needs_review": ("needs_review",), "needs_input": ("needs_input",), "progress": ("running", "publishing")}
#: The reason that a found receipt lifts.
LIFTED = "root_needs_review"
PENDING, OUT, SENT, BLOCKED = "pending", "out", "sent", "blocked"


class _Outbox(Ordered):
    """Per run: its status, and of each kind its notice: text, state, when it is due, the reason that
    blocks it, how often it went out, and its number in order."""

    columns, key_names = ("action", "kind", "text", "due_ms"), ("run_id",)
    out = ("kind", "text", "due_ms", "attempt")

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "status string, numbered int")
        self.notices = handle.getMapState("notices", "kind string", "text string, state string, due long, reason string, attempt int, n int")

    def _set(self, kind: str, text: str, state: str, due: int, reason: str | None, attempt: int, n: int) -> None:
        self.notices.updateValue((kind,), (text, state, due, reason, attempt, n))
        if state == PENDING:
            self.handle.registerTimer(due)

    def apply(self, key: tuple, at: int, row: Row) -> Iterator[tuple]:
        action, kind, due = row["action"], row["kind"] or "", int(row["due_ms"]) if row["due_ms"] is not None else at
        status, numbered = self.run.get() if self.run.exists() else (None, 0)
        old = self.notices.getValue((kind,)) if self.notices.containsKey((kind,)) else None
        if action == "status":
            self.run.update((row["text"], numbered))
        elif action == "notice" and old is None:
            self._set(kind, row["text"], PENDING, due, None, 0, numbered)
            self.run.update((status, numbered + 1))
        elif action == "retry":  # what has not been sent is of the try before
            for (k,), v in list(self.notices.iterator()):
                if v[1] != SENT:
                    self.notices.removeKey((k,))
        elif old is not None and old[1] != SENT:
            text, state, was, reason, attempt, n = old
            if action == "sent":
                self._set(kind, text, SENT, was, None, attempt, n)
            elif action == "block":
                self._set(kind, text, BLOCKED, was, row["text"], attempt, n)
            elif action == "defer":
                self._set(kind, text, state if state == BLOCKED else PENDING, due, reason, attempt, n)
            elif action == "resume" and state == BLOCKED and reason == LIFTED:
                self._set(kind, text, PENDING, due, None, attempt, n)
        yield from ()

    def due(self, key: tuple, before: int) -> Iterator[tuple]:
        status = self.run.get()[0] if self.run.exists() else None
        ready = sorted((v[2], v[5], k, v) for (k,), v in self.notices.iterator() if v[1] == PENDING and v[2] < before)
        for _, _, kind, (text, _, due, _, attempt, n) in ready:
            of = NOTICE_STATUS.get(kind.split(":")[0])
            if status == "superseded" or (of and status not in of):  # of a state that the run has left
                self._set(kind, text, SENT, due, None, attempt, n)
            else:
                self._set(kind, text, OUT, due, None, attempt + 1, n)
                yield (kind, text, due, attempt + 1)


def outbox_stream(events: DataFrame, delay: str = "1 minute", at: str = "at") -> DataFrame:
    """(run_id, kind, text, due_ms, attempt): notices as they fall due, from a stream (run_id, at,
    action, kind, text, due) in the order of ``at``.

    action is ``notice`` (one for each run and kind, due at ``due`` or at once), ``defer`` (due at
    ``due``; a notice that went out and failed goes out again), ``block`` (text is the reason),
    ``resume`` (lifts the block of a lost receipt), ``sent`` (a receipt: it never goes out again),
    ``retry`` (drops what has not been sent, so that its kinds may be told anew), or ``status`` (text is
    what the run comes to). A notice of a status that the run is no longer in, or of a superseded run,
    is used up without going out. Timers release a notice when the watermark reaches its time."""
    rows = _rows(events, at, delay, "run_id", "action", "kind", "text", F.expr("unix_millis(due)").alias("due_ms"))
    kind = events.schema["run_id"].dataType.simpleString()
    out = f"run_id {kind}, kind string, text string, due_ms long, attempt int"
    return rows.groupBy("run_id").transformWithStateInPandas(_Outbox(), out, "append", "eventtime")


def outbox_sink(folder: str, query: str = "outbox") -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch. A batch's notices are written to a folder of its own, then its id to a
    ledger; a batch that the ledger has is skipped, one that it lacks is written over. So a batch that
    is run again after a failure at any point gives each notice once. ``query`` keeps the ids of
    streams with checkpoints of their own apart."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not ledger(spark, folder, query).filter(F.col("batch_id") == batch_id).isEmpty():
            batch.write.format("noop").mode("append").save()  # its state has to move on all the same
            return
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{query}/{batch_id}")
        spark.range(1).select(F.lit(query).alias("query"), F.lit(batch_id).cast("long").alias("batch_id")).write.mode("overwrite").parquet(f"{folder}/ledger/{query}/{batch_id}")

    return write


def ledger(spark: SparkSession, folder: str, query: str = "outbox") -> DataFrame:
    """(query, batch_id) of the batches that are whole."""
    root = f"{folder}/ledger/{query}"
    spark.createDataFrame([], "query string, batch_id long").write.mode("ignore").parquet(f"{root}/none")
    return spark.read.schema("query string, batch_id long").option("recursiveFileLookup", "true").parquet(root)


def sent_notices(spark: SparkSession, folder: str, schema: str, query: str = "outbox") -> DataFrame:
    """The notices of whole batches, with their batch_id."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows/{query}")
    of = F.regexp_extract(F.input_file_name(), r"/(\d+)/[^/]*$", 1).cast("long")
    return rows.withColumn("batch_id", of).join(ledger(spark, folder, query).select("batch_id"), "batch_id", "left_semi")
