import uuid
from datetime import datetime

from groundwork.streaming import jobs


def drain(spark, df, mode="append"):
    name = f"q{uuid.uuid4().hex}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def stream(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


MESSAGES = "thread_key string, at timestamp, ts string, version double, command string, text string"


def timed(parts):
    """A second between rows, and rows of another thread that let the watermark pass them."""
    n, out = 0, []
    for rows in parts:
        out.append([(k, datetime.fromtimestamp(1704067200 + (n := n + 1)), *more) for k, *more in rows])
    return [*out, *[[("z", datetime.fromtimestamp(1704097200 + 600 * i), None, None, "done", None)] for i in range(2)]]


def test_latest_messages_pass_only_higher_versions(spark, tmp_path):
    said = [[("t", "1", 110.0, "a")], [("t", "1", 105.0, "b"), ("t", "2", 1.0, "n")], [("t", "1", 110.0, "c")], [("t", "1", 111.0, "d")]]
    s = stream(spark, tmp_path, timed([[(*r[:3], "message", r[3]) for r in rows] for rows in said]), MESSAGES)
    assert sorted((r["ts"], r["version"]) for r in drain(spark, jobs.latest_messages(s))) == [("1", 110.0), ("1", 111.0), ("2", 1.0)]


def test_quota_keeps_state_across_batches(spark, tmp_path):
    schema = "provider string, period string, arrival long, units long"
    s = stream(spark, tmp_path, [[("p", "d", 1, 1), ("p", "d", 2, 1)], [("p", "d", 3, 5)], [("p", "d", 4, 1), ("p", "e", 5, 2)]], schema)
    rows = sorted(drain(spark, jobs.quota_ledger_stream(s, 3)), key=lambda r: r["arrival"])
    assert [(r["allowed"], r["used_after"]) for r in rows] == [(True, 1), (True, 2), (False, 2), (True, 3), (True, 2)]


def test_windows_and_debounce(spark, tmp_path):
    schema = "thread string, ts timestamp"
    t = datetime.fromisoformat
    s = stream(spark, tmp_path, [[("a", t("2024-01-01 00:30")), ("a", t("2024-01-01 01:10"))], [("a", t("2024-01-01 01:15"))], [("b", t("2024-01-05 00:00"))]], schema)
    days = {r["issue_start"].isoformat(): r["n"] for r in drain(spark, jobs.issue_windows(s, "ts"))}
    assert days["2023-12-31T01:00:00"] == 1 and days["2024-01-01T01:00:00"] == 2
    runs = [(r["thread"], r["n"]) for r in drain(spark, jobs.debounce_revisions(s, "thread", "ts", "10 minutes"))]
    assert sorted(runs) == [("a", 1), ("a", 2)]


def test_equal_content_only_advances_the_version(spark, tmp_path):
    said = [[("t", "1", 1.0, "a")], [("t", "1", 3.0, "a")], [("t", "1", 2.0, "b")], [("t", "1", 4.0, "b")]]
    s = stream(spark, tmp_path, timed([[(*r[:3], "message", r[3]) for r in rows] for rows in said]), MESSAGES)
    assert sorted(r["version"] for r in drain(spark, jobs.latest_messages(s))) == [1.0, 4.0]


def test_controls_are_bound_to_the_revision_they_first_met(spark, tmp_path):
    parts = [
        [("t", "9", 50.0, "cancel")],  # no revision yet
        [("t", "1", 100.0, "message")],
        [("t", "2", 90.0, "cancel")],  # older than the message
        [("t", "3", 110.0, "cancel")],  # applied
        [("t", "3", 110.0, "cancel")],  # replayed
        [("t", "3", 111.0, "cancel")],  # the same command again
        [("t", "3", 112.0, "retry")],  # nothing to retry after a cancel
        [("t", "4", 120.0, "message")],
        [("t", "3", 121.0, "retry")],  # bound to the first revision
        [("t", "4", 0.0, "failed")],
        [("t", "5", 130.0, "retry")],  # applied
        [("t", "4", 0.0, "publishing")],
        [("t", "6", 131.0, "cancel")],  # rejected while publishing
        [("u", "1", 10.0, "message")],
        [("u", "2", 11.0, "cancel")],
    ]
    s = stream(spark, tmp_path, timed([[(*r, None) for r in rows] for rows in parts]), MESSAGES)
    rows = sorted((r["thread_key"], r["version"], r["ts"], r["revision"], r["outcome"]) for r in drain(spark, jobs.apply_controls(s)))
    assert [(v, rev, o) for k, v, _, rev, o in rows if k == "t"] == [
        (50.0, 0, "ignored"), (90.0, 1, "ignored"), (110.0, 1, "applied"), (110.0, 1, "duplicate"), (111.0, 1, "ignored"), (112.0, 1, "rejected"), (121.0, 1, "ignored"), (130.0, 2, "applied"), (131.0, 2, "rejected"),
    ]
    assert [(v, rev, o) for k, v, _, rev, o in rows if k == "u"] == [(11.0, 1, "applied")]


def test_late_rows_go_to_a_side_table(spark, tmp_path):
    t = datetime.fromisoformat
    schema = "id int, ts timestamp, received timestamp"
    s = stream(spark, tmp_path, [[(1, t("2024-01-01 00:00"), t("2024-01-01 00:04")), (2, t("2024-01-01 00:00"), t("2024-01-01 00:06"))]], schema)
    assert [r["id"] for r in drain(spark, jobs.drop_late(s, "ts", "received"))] == [1]
    assert [r["id"] for r in drain(spark, jobs.late_rows(s, "ts", "received"))] == [2]


def test_delivered_events_are_of_finished_live_runs(spark, tmp_path):
    runs = spark.createDataFrame([(1, "done", False, "m"), (2, "done", True, "m"), (3, "failed", False, "m"), (4, "done", False, "")], "id int, status string, dry_run boolean, media_id string")
    s = stream(spark, tmp_path, [[(i, f"e{i}") for i in range(1, 5)]], "run_id int, event_id string")
    assert [tuple(r) for r in drain(spark, jobs.delivered_ledger(s, runs))] == [(1, "e1")]


def test_messages_of_known_people(spark, tmp_path):
    from groundwork.sources import landed

    path = tmp_path / "m"
    path.mkdir()
    rows = ['{"workspace": "w", "channel": "c", "user": "%s", "ts": "%d", "bot": %s}' % x for x in (("a", 1, "false"), ("b", 2, "false"), ("a", 3, "true"))]
    (path / "x.json").write_text("\n".join(rows))
    assert [r["ts"] for r in drain(spark, landed.read_message_stream(spark, str(path), "w", ("a",)))] == ["1"]
