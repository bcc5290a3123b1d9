"""Threads and outbox in the order of time: permutations, divisions into batches, restarts."""

import hashlib
import itertools
import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from groundwork.streaming import ordered

START = datetime(2024, 1, 1)
MESSAGES = "thread_key string, at timestamp, ts string, version double, command string, text string"
EVENTS = "run_id int, at timestamp, action string, kind string, text string, due timestamp"


def t(seconds):
    return START + timedelta(seconds=seconds)


def stream(spark, folder, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def drain(spark, df):
    name = f"q{uuid.uuid4().hex}"
    df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(200)
    return spark.table(name).collect()


def end(key, n):
    """Rows, one a part, that let the watermark pass what came before."""
    return [[(key, t(90_000 + 900 * i), *([None] * n))] for i in range(2)]


THREAD = [
    ("t", t(1), "9", 50.0, "cancel", None),  # no revision yet
    ("t", t(2), "1", 100.0, "message", "a"),
    ("t", t(3), "2", 90.0, "cancel", None),  # older than the message
    ("t", t(4), "1", 101.0, "message", "a"),  # the same content advances the version
    ("t", t(5), "1", 101.0, "message", "b"),  # no higher version
    ("t", t(6), "3", 110.0, "cancel", None),  # applied
    ("t", t(7), "3", 111.0, "cancel", None),  # the same command
    ("t", t(8), "3", 112.0, "message", "not a command"),  # an edited control message starts a revision
    ("t", t(9), "3", 113.0, "retry", None),  # bound to the first revision
    ("t", t(10), "x", None, "failed", None),
    ("t", t(11), "5", 130.0, "retry", None),  # applied
    ("t", t(12), "x", None, "publishing", None),
    ("t", t(13), "6", 131.0, "cancel", None),  # rejected while publishing
    ("t", t(14), "7", 132.0, "message", "c"),  # busy
    ("t", t(15), "x", None, "done", None),
    ("t", t(16), "7", 133.0, "message", "c"),
    ("t", t(17), "8", 134.0, "message", "d"),  # supersedes the queued one
    ("t", t(17), "8", 132.0, "message", "e"),  # at the same time, after it by no rule but its content
]
WANT = [
    (1, 0, "ignored"), (2, 1, "accepted"), (3, 1, "ignored"), (4, 1, "duplicate"), (5, 1, "duplicate"), (6, 1, "applied"), (7, 1, "ignored"), (8, 2, "accepted"), (9, 1, "ignored"),
    (11, 2, "applied"), (13, 2, "rejected"), (14, 2, "busy"), (16, 3, "accepted"), (17, 4, "accepted"), (17, 4, "duplicate"),
]


@pytest.mark.parametrize("seed", range(3))
def test_threads_do_not_depend_on_arrival(spark, tmp_path, seed):
    """One micro-batch in any order, many of them, and replays, come to the same."""
    draw = random.Random(seed)
    rows = list(THREAD) + draw.sample(THREAD, 4 * seed)  # with replays
    draw.shuffle(rows)
    step = [len(rows), 1 + len(rows) // 2, 5][seed]
    parts = [rows[i : i + step] for i in range(0, len(rows), step)] + end("z", 4)
    got = [r for r in drain(spark, ordered.ordered_threads(stream(spark, tmp_path, parts, MESSAGES))) if r["thread_key"] == "t"]
    ms = int(datetime.fromisoformat("2024-01-01T00:00:00+00:00").timestamp() * 1000)
    assert sorted(((r["at_ms"] - ms) // 1000, r["revision"], r["outcome"]) for r in got) == WANT
    assert [r["superseded"] for r in got if r["at_ms"] == ms + 17_000 and r["outcome"] == "accepted"] == [3]


def test_every_permutation_of_a_batch(spark, tmp_path):
    """24 threads that hold the same four messages, each in another order."""
    four = [(1, "1", 10.0, "message", "a"), (2, "2", 11.0, "cancel", None), (2, "2", 12.0, "retry", None), (3, "1", 13.0, "message", "b")]
    rows = [(f"t{i}", t(r[0]), *r[1:]) for i, order in enumerate(itertools.permutations(four)) for r in order]
    got = drain(spark, ordered.ordered_threads(stream(spark, tmp_path, [rows, *end("z", 4)], MESSAGES)))
    by = {}
    for r in got:
        by.setdefault(r["thread_key"], []).append((r["at_ms"], r["version"], r["revision"], r["outcome"], r["superseded"]))
    assert len(by) == 24 + ("z" in by) and len({tuple(sorted(v, key=str)) for k, v in by.items() if k != "z"}) == 1


def test_equal_to_a_fold_over_the_whole(spark, tmp_path):
    """Random threads against a fold in plain Python over all rows in order."""
    draw = random.Random(9)
    rows = []
    for i in range(300):
        kind = draw.choice(["message"] * 4 + ["cancel", "retry", "failed", "publishing", "done"])
        rows.append((f"t{draw.randrange(4)}", t(i), str(draw.randrange(5)), float(draw.randrange(400)), kind, draw.choice("ab")))
    want, state = [], {}
    for k, at, ts, version, command, text in rows:
        s = state.setdefault(k, {"rev": 0, "status": None, "messages": {}, "controls": {}})
        if command in ("failed", "publishing", "done"):
            s["status"] = command if s["rev"] else None
            continue
        m, c, bound, outcome = s["messages"].get(ts), s["controls"].get(ts), s["rev"], "ignored"
        high = max([v for v, _ in s["messages"].values()] + [v for r, v, _ in s["controls"].values() if r == s["rev"]], default=-1)
        if (m and version <= m[0]) or (c and version <= c[1]):
            outcome = "duplicate"
        elif command == "message" and m and m[1] == text:
            outcome, s["messages"][ts] = "duplicate", (version, text)
        elif command == "message" and s["status"] == "publishing":
            outcome = "busy"
        elif command == "message":
            s["messages"][ts], s["rev"], s["status"], outcome = (version, text), s["rev"] + 1, "queued", "accepted"
            bound = s["rev"]
        elif s["rev"]:
            bound = c[0] if c else s["rev"]
            if bound == s["rev"] and version >= high and not (c and c[2] == command):
                if command == "retry":
                    outcome = "applied" if s["status"] == "failed" else "rejected"
                else:
                    outcome = "rejected" if s["status"] == "publishing" else "applied" if s["status"] == "queued" else "ignored"
                s["status"] = {"retry": "queued", "cancel": "cancelled"}[command] if outcome == "applied" else s["status"]
            s["controls"][ts] = (bound, version, command)
        want.append((k, at, bound, outcome))
    draw.shuffle(rows)
    got = drain(spark, ordered.ordered_threads(stream(spark, tmp_path, [rows[:120], rows[120:], *end("z", 4)], MESSAGES), delay="1 hour"))
    mine = sorted((r["thread_key"], START + timedelta(milliseconds=r["at_ms"] - 1704067200000), r["revision"], r["outcome"]) for r in got if r["thread_key"] != "z")
    assert mine == sorted(want) and len(hashlib.sha256(str(mine).encode()).hexdigest()) == 64


OUTBOX = [
    (1, t(1), "notice", "accepted", "one", None),
    (1, t(2), "notice", "accepted", "again", None),  # one for each run and kind
    (1, t(3), "status", None, "running", None),
    (1, t(4), "notice", "progress:1", "p", t(600)),  # the run is done by then
    (1, t(5), "status", None, "done", None),
    (1, t(6), "notice", "done", "two", t(50)),
    (1, t(7), "defer", "done", None, t(300)),  # released later
    (1, t(301), "defer", "done", None, t(400)),  # it failed to go out
    (1, t(401), "sent", "done", None, None),
    (1, t(402), "defer", "done", None, t(500)),  # has gone out
    (2, t(1), "notice", "done", "lost", t(20)),
    (2, t(2), "status", None, "superseded", None),
    (3, t(1), "notice", "hello", "blocked", t(20)),
    (3, t(2), "block", "hello", "root_needs_review", None),
    (3, t(30), "resume", "hello", None, t(200)),
    (4, t(1), "notice", "hello", "blocked", t(20)),
    (4, t(2), "block", "hello", "invalid_route", None),
    (4, t(30), "resume", "hello", None, t(40)),
    (5, t(1), "notice", "failed:1", "first", t(100)),
    (5, t(2), "retry", None, None, None),
    (5, t(3), "status", None, "failed", None),
    (5, t(4), "notice", "failed:1", "second", None),
]
SENT = [(1, "accepted", "one", 1, 1), (1, "done", "two", 300, 1), (1, "done", "two", 400, 2), (3, "hello", "blocked", 200, 1), (5, "failed:1", "second", 4, 1)]


def rows_of(got):
    return sorted((r["run_id"], r["kind"], r["text"], (r["due_ms"] - 1704067200000) // 1000, r["attempt"]) for r in got if r["run_id"] < 9)


@pytest.mark.parametrize("step", [len(OUTBOX), 4])
def test_outbox_by_time(spark, tmp_path, step):
    rows = list(OUTBOX)
    random.Random(step).shuffle(rows)
    parts = [rows[i : i + step] for i in range(0, len(rows), step)] + end(9, 4)
    assert rows_of(drain(spark, ordered.outbox_stream(stream(spark, tmp_path, parts, EVENTS), delay="1 hour"))) == SENT


def test_deferred_notice_waits_for_its_time(spark, tmp_path):
    """A notice due later is held by its timer while the watermark is before it."""
    s = stream(spark, tmp_path, [[(1, t(0), "notice", "hello", "x", t(500))], [(2, t(200), "notice", "soon", "y", None)], [(2, t(400), "status", None, "running", None)], [(2, t(450), "status", None, "running", None)]], EVENTS)
    assert [r["kind"] for r in drain(spark, ordered.outbox_stream(s, delay="1 second"))] == ["soon"]


@pytest.mark.parametrize("at", ["rows", "ledger"])
def test_restart_in_the_middle_of_a_batch(spark, tmp_path, at):
    """The sink fails once after the rows, or after the ledger, of each batch; nothing goes out twice."""
    parts = [OUTBOX[:8], OUTBOX[8:], *end(9, 4)]
    s = ordered.outbox_stream(stream(spark, tmp_path, parts, EVENTS), delay="1 hour")
    folder, failed = f"{tmp_path}/out", set()
    sink = ordered.outbox_sink(folder)

    def unsteady(batch, batch_id):
        if batch_id not in failed:
            failed.add(batch_id)
            if at == "rows":
                batch.write.mode("overwrite").parquet(f"{folder}/rows/outbox/{batch_id}")
            else:
                sink(batch, batch_id)
            raise RuntimeError("lost")
        sink(batch, batch_id)

    for _ in range(12):
        q = s.writeStream.foreachBatch(unsteady).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        try:
            q.awaitTermination(200)
            break
        except Exception:  # noqa: BLE001
            continue
    got = ordered.sent_notices(spark, folder, "run_id int, kind string, text string, due_ms long, attempt int")
    assert len(failed) >= 3 and rows_of(got.collect()) == SENT
    assert ordered.ledger(spark, folder).groupBy("batch_id").count().filter(F.col("count") > 1).count() == 0
