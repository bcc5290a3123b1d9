import datetime as dt

from pyspark.sql import functions as F

from groundwork.operators import drafts as D
from groundwork.operators import outline as O


def test_limits_of_drafts(spark):
    rows = [(1, 1, "e", "Head", "x" * 461, 400), (1, 2, "e", "Ends.", "x" * 460, 400), (2, 1, "f", "H", "**ab** [cd](u) e" + "x" * 295, 400)]
    got = D.validate_drafts(spark.createDataFrame(rows, "draft_id int, item int, event_id string, heading string, body string, target int")).collect()
    assert {(r["draft_id"], r["item"], r["rule"]) for r in got} == {(1, 1, "item-too-long"), (1, 2, "heading-ends-in-stop"), (1, None, "event-twice")}
    assert spark.range(1).select(D.plain_length(F.lit("**ab** [cd](u) e"))).first()[0] == 5


def test_narrowing(spark):
    body = "A long supported sentence stands here with many words in it for the sake of length. Bad one. And another supported sentence of some length."
    items = spark.createDataFrame([(1, 1, body), (2, 1, body)], "draft_id int, item int, body string")
    bad = spark.createDataFrame([(1, 1, "Bad one. "), (2, 1, "supported sentence")], "draft_id int, item int, sentence string")
    got = {r["draft_id"]: (r["narrowed"], "Bad" in r["body"]) for r in D.narrow_drafts(items, bad).collect()}
    assert got == {1: (True, False), 2: (False, True)}


def test_retranslation_plan(spark):
    u = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "the Term", "b", "c", "d"])], "doc_id int, ord int, text string")
    assert [D.plan_retranslation(u, k, ["term"]).count() for k in (["title"], ["term"], ["style"])] == [0, 3, 5]


def test_paper_blocks(spark):
    rows = [("paragraph", None, "My Title"), ("figure", None, "f"), ("heading", 1, "Abstract"), ("paragraph", None, "x"), ("heading", 1, "References"), ("paragraph", None, "[1]"), ("heading", 1, "Appendix"), ("paragraph", None, "y")]
    b = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id int, ord int, type string, level int, text string")
    docs = spark.createDataFrame([(1, "my title", ["A"])], "doc_id int, title string, authors array<string>")
    assert [r["ord"] for r in O.crop_paper_main(b, docs).orderBy("ord").collect()] == [0, 1, 2, 3, 4, 5]
    assert [r["ord"] for r in D.drop_repeated_preamble(b, docs).orderBy("ord").collect()] == [1, 2, 3, 4, 5, 6, 7]
    assert not D.translation_completeness(b, b.filter("type <> 'figure'")).first()["complete"]


def test_quota_and_context(spark):
    t = dt.datetime
    b = spark.createDataFrame([("p", "old", t(2024, 1, 1), 5, 10), ("p", "new", t(2024, 2, 1), 10, 12), ("p", "next", t(2024, 3, 1), 0, 12)], "provider string, period string, period_start timestamp, used long, limit_units long")
    r = D.quota_status(b, F.to_timestamp(F.lit("2024-02-15")), {"p": 11}).first()
    assert (r["period"], r["capacity"], r["remaining"], r["state"]) == ("new", 11, 1, "low")
    c = D.freeze_context(spark.createDataFrame([("d", t(2024, 1, 2)), ("d", t(2024, 1, 1))], "issue_date string, started_at timestamp")).first()
    assert c["cutoff_at"] == t(2024, 1, 1) and c["supplement_start"] == t(2023, 12, 25)


def test_small_draft_jobs(spark):
    u = spark.createDataFrame([("a", "**x** fine long text here"), ("b", "**bold but open"), ("c", "**much of this** y")], "unit_id string, text string")
    assert {(r["unit_id"], r["rule"]) for r in D.lint_highlights(u).collect()} == {("a", "length"), ("b", "unbalanced"), ("c", "coverage")}
    m = spark.createDataFrame([("t", '[{"url":"https://f/1","mimetype":"text/plain"},{"url":"https://f/2","mimetype":"image/png"}]', "see https://e.com/a and https://c.com")], "thread_key string, files string, text string")
    got = D.select_materials(m, spark.createDataFrame([("t", "https://c.com")], "thread_key string, url string")).collect()
    assert sorted(r["url"] for r in got) == ["https://e.com/a", "https://f/1"] and not got[0]["too_many"]
    i = spark.createDataFrame([(0, "a", "high", "r1"), (0, "a", "low", "r2"), (0, "a", "low", "r2")], "pass int, scope string, severity string, reason string")
    assert D.rollup_findings(i).first().asDict() == {"pass": 0, "scope": "a", "high": 1, "warnings": ["r2"]}
    t = spark.createDataFrame([("1", "plain words here", "译文", "intro", False, 0), ("2", "it is not so", "译", "intro", False, 0)], "unit_id string, source string, target string, section string, repaired boolean, warnings int")
    assert [(r["unit_id"], r["review_reason"]) for r in D.review_triage(t).collect()] == [("2", "risk-words")]


def test_what_is_left_to_do_after_an_edit(spark):
    """Published counts: a title edit asks for no block, a term hit in five blocks for the hit and its
    two neighbours, anything else for all; equal fingerprints ask for nothing."""
    from groundwork.operators import latest as L

    u = spark.createDataFrame([(1, i, "the agent acts" if i == 2 else f"block {i}") for i in range(5)], "doc_id int, ord int, text string")
    assert D.plan_retranslation(u, ["title"]).count() == 0 and D.plan_retranslation(u, ["cover", "title"]).count() == 0
    assert sorted(r["ord"] for r in D.plan_retranslation(u, ["term"], ["Agent"]).collect()) == [1, 2, 3]
    assert D.plan_retranslation(u, ["tone"]).count() == 5
    cache = u.select(L.fingerprint("doc_id", "text").alias("fingerprint"))
    assert L.reuse_by_fingerprint(u, cache, ["doc_id", "text"]).filter("not hit").count() == 0
    assert L.reuse_by_fingerprint(u, cache.limit(0).unionByName(cache.filter("fingerprint is not null").exceptAll(cache.limit(1))), ["doc_id", "text"]).filter("not hit").count() == 1
