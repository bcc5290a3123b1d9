"""Payloads of all providers, and the rules by which messages are taken."""

import json

import pytest

from groundwork.sources import landed

ROWS = {
    "release": [{"id": "7", "repository": "Own/Rep", "name": None, "tag_name": "v1", "html_url": "https://h.example/1", "published_at": "2026-10-02T00:00:00Z", "body": "b"}, {"id": "8", "repository": "o/r", "name": "x", "html_url": "https://h.example/2", "prerelease": True}, {"name": "x", "html_url": "https://h.example/3", "private": True}],
    "works": [{"display_name": "W", "doi": "https://doi.org/10.1/x", "publication_date": "2026-10-01", "best_oa_location": {"landing_page_url": "https://p.example/", "pdf_url": "https://p.example/a.pdf"}, "authorships": [{"author": {"display_name": "A"}}, {"author": {}}]}, {"display_name": "no address"}, {"title": "T", "doi": "https://doi.org/10.1/y"}],
    "daily-papers": [{"title": "D", "publishedAt": "2026-10-03T00:00:00Z", "paper": {"id": "2401.00001v2", "summary": "s", "publishedAt": "2026-10-01T00:00:00Z"}}, {"title": "none", "paper": {"id": "x"}}, {"paper": {"id": "2401.00002", "title": "inner"}}],
    "paper-index": [{"title": "I", "url": "https://arxiv.org/abs/2401.00003v1", "abstract": "a", "created": "2026-10-01"}, {"title": "elsewhere", "url": "https://e.example/"}],
    "search": [{"title": "S", "url": "https://e.example/a", "content": "c", "published_date": "2026-10-01"}, {"url": "https://arxiv.org/pdf/2401.00004", "snippet": "p"}, {"title": "no address"}],
}
WANT = {
    "release": [("Own/Rep v1", "https://h.example/1", "b", "release:own/rep:7", "release", True, None, True, False)],
    "works": [("T", "https://doi.org/10.1/y", None, None, "paper", False, None, False, False), ("W", "https://p.example/", None, None, "paper", False, "https://p.example/a.pdf", False, True)],
    "daily-papers": [("D", "https://arxiv.org/abs/2401.00001", "s", None, "paper", False, "https://arxiv.org/pdf/2401.00001", False, True), ("inner", "https://arxiv.org/abs/2401.00002", None, None, "paper", False, "https://arxiv.org/pdf/2401.00002", False, False)],
    "paper-index": [("I", "https://arxiv.org/abs/2401.00003", "a", None, "paper", False, "https://arxiv.org/pdf/2401.00003", False, False)],
    "search": [("S", "https://e.example/a", "c", None, "news", False, None, False, True), ("https://arxiv.org/pdf/2401.00004", "https://arxiv.org/pdf/2401.00004", "p", None, "paper", False, "https://arxiv.org/pdf/2401.00004", False, False)],
}


@pytest.mark.parametrize("provider", sorted(ROWS))
def test_payloads(spark, tmp_path, provider):
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, ROWS[provider])))
    got = landed.read_api_payloads(spark, str(tmp_path / "p.json"), provider).collect()
    assert sorted(((r["title"], r["url"], r["summary"], r["event_id"], r["kind"], r["official"], r["pdf_url"], r["date_verified"], r["discovered"] is not None) for r in got), key=str) == WANT[provider]
    assert all((r["published"] is not None) == (provider == "release") and r["provider"] == provider for r in got)
    if provider == "works":
        assert sorted(r["authors"] for r in got) == [[], ["A"]]


BASE = {"team": "T", "channel": "C", "user": "U", "received": 1000.0}


def event(**more):
    return {**BASE, "event_ts": more.get("ts"), **more}


CASES = {
    "first": (event(ts="900.1", text="<@B> read <https://a.example/x?a=1&amp;b=2|here> &lt;now&gt;"), ("C:900.1", 900.1, "message", "read https://a.example/x?a=1&b=2 <now>")),
    "no mention": (event(ts="901", text="read it"), None),
    "too old": (event(ts="600", text="<@B> read"), None),
    "known": (event(ts="902", thread_ts="100", text="more"), ("C:100", 902.0, "message", "more")),
    "unknown thread": (event(ts="903", thread_ts="55", text="<@B> more"), None),
    "stop": (event(ts="904", thread_ts="100", text="<@B> 停止当前任务"), ("C:100", 904.0, "cancel", "停止当前任务")),
    "retry": (event(ts="905", thread_ts="100", text="Retry"), ("C:100", 905.0, "retry", "Retry")),
    "stop first": (event(ts="906", text="<@B> stop"), ("C:906", 906.0, "message", "stop")),
    "edit": (event(subtype="message_changed", ts=None, event_ts="950", message={"user": "U", "ts": "907", "thread_ts": "100", "text": "new", "edited": {"ts": "940.5"}}), ("C:100", 940.5, "message", "new")),
    "edit without time": (event(subtype="message_changed", ts=None, event_ts="951", message={"user": "U", "ts": "908", "thread_ts": "100", "text": "new"}), ("C:100", 951.0, "message", "new")),
    "bot": (event(ts="909", thread_ts="100", text="x", bot_id="B9"), None),
    "joined": (event(ts="910", thread_ts="100", text="x", subtype="channel_join"), None),
    "file": (event(ts="911", thread_ts="100", text=" ", subtype="file_share", files=[{"id": "F"}]), ("C:100", 911.0, "message", "")),
    "nothing": (event(ts="912", thread_ts="100", text=" <@B> "), None),
    "other person": (event(ts="913", thread_ts="100", text="x", user="V"), None),
    "other channel": (event(ts="914", thread_ts="100", text="x", channel="D"), None),
    "no time": (event(ts=None, thread_ts="100", text="x"), None),
}


def test_messages_are_taken_by_rule(spark, tmp_path):
    rows = [r for r, _ in CASES.values()]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, rows)))
    events, threads = spark.read.schema(landed.EVENT).json(str(tmp_path / "e.json")), spark.createDataFrame([("C:100",), ("C:100",)], "thread_key string")
    got = landed.message_events(events, threads, "T", "C", "U", "B").collect()
    assert sorted((r["thread_key"], r["version"], r["command"], r["text"]) for r in got) == sorted(w for _, w in CASES.values() if w)
    assert {r["n_files"] for r in got} == {0, 1} and all(r["at"] is not None for r in got)


def test_messages_feed_the_ordered_threads(spark, tmp_path):
    from groundwork.streaming import ordered

    (tmp_path / "in").mkdir()
    (tmp_path / "in/0.json").write_text("\n".join(json.dumps(r) for r, w in CASES.values() if w))
    (tmp_path / "in/1.json").write_text(json.dumps(event(ts="5000", thread_ts="100", text="late")))
    events = spark.readStream.schema(landed.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    taken = landed.message_events(events, spark.createDataFrame([("C:100",)], "thread_key string"), "T", "C", "U", "B")
    ordered.ordered_threads(taken).writeStream.format("memory").queryName("taken").trigger(availableNow=True).start().awaitTermination(200)
    got = [(r["version"], r["outcome"]) for r in spark.table("taken").filter("thread_key = 'C:100'").orderBy("at_ms").collect()]
    assert got == [(902.0, "accepted"), (904.0, "applied"), (905.0, "rejected"), (911.0, "accepted"), (940.5, "accepted"), (951.0, "accepted")]


def test_text_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("")
    got = {r["path"][-5:]: r["text"] for r in landed.read_text_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "one\ntwo\n" and set(got) <= {"a.txt", "b.txt"}
