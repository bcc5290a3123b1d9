import datetime as dt

import pytest
from pyspark.sql import functions as F

from groundwork.functions.columns import arxiv_identity, canonical_url, event_identity, numeric_tokens, redacted
from groundwork.operators import candidates as C
from groundwork.operators import documents as D
from groundwork.operators import evidence as E
from groundwork.operators import latest as L
from groundwork.operators import ledgers as G
from groundwork.operators import threads as H


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Example.COM/a?utm_source=x&b=1#top", "https://example.com/a?b=1"),
        ("http://example.com", "http://example.com/"),
        ("https://user:pw@example.com/", None),
        ("ftp://example.com/", None),
        ("https://e.com/?token=1&X-Amz-Date=2&page=3", "https://e.com/?page=3"),
    ],
)
def test_canonical_url(spark, url, want):
    assert value(spark, canonical_url(F.lit(url))) == want


def test_identity_order(spark):
    arxiv = F.lit("https://arxiv.org/abs/2501.01234v2")
    none = F.lit(None).cast("string")
    assert value(spark, arxiv_identity(arxiv)).asDict() == {"base_id": "2501.01234", "version": "v2"}
    assert value(spark, event_identity(arxiv, F.lit("e1"), F.lit("10.1/x"))) == "arxiv:2501.01234v2"
    assert value(spark, event_identity(F.lit("https://e.com/"), F.lit("e1"), F.lit("10.1/x"))) == "e1"
    assert value(spark, event_identity(F.lit("https://e.com/"), none, F.lit("https://doi.org/10.1/X"))) == "doi:10.1/x"


@pytest.mark.parametrize(
    ("text", "want"),
    [("Prices [0.10,0.90] and liquidity $5,000.", ["0.10", "0.90", "5000"]), ("−35.1% −0.6% 3e-05", ["-35.1", "-0.6", "3e-05"]), ("pages 10-12", ["10", "12"]), ("none", [])],
)
def test_numeric_tokens(spark, text, want):
    assert value(spark, numeric_tokens(F.lit(text))) == want


def test_redaction_needs_a_boundary(spark):
    assert value(spark, redacted(F.lit("token=abc xoxb-123 task-sk-abcdefghijklmno"))) == "token=[REDACTED] [REDACTED] task-[REDACTED]"
    assert "abc" not in value(spark, redacted(F.lit("secret=abc&x=1")))


def test_temporal_status(spark):
    ts = lambda s: F.to_timestamp(F.lit(s))
    ctx = (ts("2026-10-03 00:00:00"), ts("2026-10-02 00:00:00"), ts("2026-09-26 00:00:00"))
    status = lambda at, p, v=True: value(spark, C.temporal_status(ts(at), F.lit(p), F.lit(v), *ctx))
    assert status("2026-10-03 01:00:00", "instant") == "future"
    assert status("2026-10-02 00:00:00", "instant") == "current"
    assert status("2026-10-01 00:00:00", "day") == "supplement"
    assert status("2026-10-02 00:00:00", "day") == "current"
    assert status("2026-09-25 00:00:00", "day") == "old"
    assert status("2026-10-02 00:00:00", "instant", False) == "unverified"


def test_entities_are_transitive(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "x"), (4, "c", None), (5, None, None)], "id int, k string, m string")
    assert dict(C.resolve_entities(rows, "id", ["k", "m"]).collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_slots_fill_up(spark):
    rows = spark.createDataFrame([(i, "paper" if i < 3 else "x", "llm" if i in (0, 5) else "y", 100 - i) for i in range(10)], "id int, kind string, topic string, score int")
    got = [r["id"] for r in C.select_deep_reads(rows, [("kind", ["paper"], 2), ("topic", ["llm"], 1)], 4).collect()]
    assert got == [0, 1, 2, 3]  # id 0 takes the llm slot again, the fill makes up for it


def test_primary_overlay_keeps_nulls(spark):
    c = spark.createDataFrame([("a", "old", "1"), ("b", "old", "2")], "k string, title string, doi string")
    p = spark.createDataFrame([("a", None, "9")], "k string, title string, doi string")
    assert {r["k"]: (r["title"], r["doi"]) for r in C.resolve_with_primary(c, p, "k", ["doi"]).collect()} == {"a": (None, "1"), "b": ("old", "2")}


def test_excerpts_concatenate_to_the_source(spark):
    text = "Head.\nA first sentence here. And another one follows! ok\n\nTail\nx"
    rows = D.build_excerpts(spark.createDataFrame([(1, text), (2, ""), (3, "short")], "doc_id int, text string"), ["doc_id"]).orderBy("doc_id", "n").collect()
    assert "".join(r["quote"] for r in rows if r["doc_id"] == 1) == text
    assert all(len(r["quote"].strip()) >= 8 for r in rows if r["doc_id"] == 1)
    assert [r["quote"] for r in rows if r["doc_id"] == 3] == ["short"]


def test_quotes_meet_modulo_white_space(spark):
    docs = spark.createDataFrame([(1, "one two three\nfour  five six seven eight nine"), (2, "none of it"), (3, None)], "doc_id int, text string")
    items = spark.createDataFrame([(7, "two three four five six seven eight"), (8, "of it"), (9, "none of it")], "item_id int, text string")
    assert sorted(map(tuple, E.find_quotes(items, docs).collect())) == [(7, 1), (9, 2)]
    assert sorted(map(tuple, E.find_quotes(items, docs, k=3, gram=2).collect())) == [(7, 1), (9, 2)]


def test_gap_candidates_rank(spark):
    missing = spark.createDataFrame([(1, "5"), (1, "7")], "sent_id int, token string")
    ex = spark.createDataFrame([("a", "5 and 7 here"), ("b", "5 7"), ("c", "only 5")], "excerpt_id string, quote string")
    assert [(r["rank"], r["excerpt_id"], r["covered"]) for r in E.numeric_gap_candidates(missing, ex).orderBy("rank").collect()] == [(1, "b", 2), (2, "a", 2)]


def test_refs_are_trimmed_to_cover(spark):
    refs = spark.createDataFrame([(1, i) for i in range(9)], "claim_id int, ord int")
    tokens = spark.createDataFrame([(1, 8, "x"), (1, 2, "y"), (1, 5, "y")], "claim_id int, ord int, token string")
    assert sorted(r["ord"] for r in E.trim_refs(tokens, refs).collect()) == [0, 1, 2, 3, 4, 8]


def test_citations_number_by_first_use(spark):
    bodies = spark.createDataFrame([(1, "x [S2] y [1] z [S2] 【9】")], "body_id int, text string")
    known, unknown = E.resolve_citations(bodies, spark.createDataFrame([("S1",), ("S2",)], "source_id string"))
    assert {r["source_id"]: r["number"] for r in known.collect()} == {"S2": 1, "S1": 2}
    assert [r["source_id"] for r in unknown.collect()] == ["S9"]


def test_denied_requests_use_nothing(spark):
    r = spark.createDataFrame([("p", i, u) for i, u in enumerate([1, 1, 1, 5, 2])], "k string, at int, units int")
    rows = sorted(G.quota_ledger(r, ["k"], ["at"], 4).collect(), key=lambda x: x["at"])
    assert [(x["allowed"], x["used_after"]) for x in rows] == [(True, 1), (True, 2), (True, 3), (False, 3), (False, 3)]


def test_upsert_and_ignore(spark):
    base = spark.createDataFrame([("a", 1), ("b", 5)], "k string, v int")
    more = spark.createDataFrame([("a", 3), ("c", 2), ("c", 1)], "k string, v int")
    assert dict(L.upsert_latest(base, more, ["k"], [F.col("v").desc()]).collect()) == {"a": 3, "b": 5, "c": 2}
    assert dict(L.insert_ignore(base, more, ["k"], [F.col("v")]).collect()) == {"a": 1, "b": 5, "c": 1}


def test_batches_and_chunks(spark):
    u = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([3, 4, 9, 1, 1, 1])], "doc int, n int, text string")
    assert [r["batch"] for r in H.pack_batches(u, "doc", "n", chars=8, items=2).orderBy("n").collect()] == [1, 1, 2, 3, 3, 4]
    t = "word " * 50
    parts = [r["part"] for r in H.chunk_text(spark.createDataFrame([(1, t)], "doc int, text string"), ["doc"], 60).orderBy("n").collect()]
    assert "".join(parts) == t and max(map(len, parts)) <= 60


def test_ancestors_stop_on_cycles(spark):
    runs = spark.createDataFrame([(1, None, "t"), (2, 1, "t"), (3, 2, "t"), (4, 5, "c"), (5, 4, "c"), (6, 3, "other")], "id int, parent_id int, thread_key string")
    art = spark.createDataFrame([(1,)], "id int")
    assert {r["id"]: (r["ancestor"], r["depth"]) for r in H.nearest_ancestor(runs, art, most=5).collect()} == {2: (1, 1), 3: (1, 2)}


def test_retry_delays(spark):
    now = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    at = dt.datetime(2024, 1, 1, 12)
    rows = [(1, "failed", True, None, 0, at), (2, "failed", True, None, 1, at), (3, "failed", True, None, 2, at), (4, "failed", False, None, 0, at), (5, "failed", True, "m", 0, at)]
    r = spark.createDataFrame(rows, "id int, status string, retryable boolean, media_id string, retry_count int, created_at timestamp")
    got = G.retry_plan(r, now).select("id", (F.unix_timestamp("retry_at") - F.unix_timestamp(now)).alias("s")).collect()
    assert {x["id"]: x["s"] for x in got} == {1: 60, 2: 300}
