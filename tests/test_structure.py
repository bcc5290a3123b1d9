import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from groundwork.operators import outline as O
from groundwork.operators import review as R
from groundwork.operators import structure as S
from groundwork.sources import landed


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2026-02-30", None), ("2026-10", None), ("2026-10-02", ("2026-10-02T00:00:00", "day")), ("2026-10-02T10:00:00", ("2026-10-02T00:00:00", "day")),
        ("Fri, 02 Oct 2026 10:00:00 GMT", ("2026-10-02T10:00:00", "instant")), ("2026-10-02T10:00:00Z", ("2026-10-02T10:00:00", "instant")),
    ],
)
def test_days_and_instants(spark, text, want):
    got = value(spark, landed.day_or_instant(F.lit(text)))
    assert (got and (got["at"].isoformat(), got["precision"])) == want


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<feed><entry><id>https://arxiv.org/abs/2501.01234v2</id><title> A  title </title><published>2025-01-02T00:00:00Z</published><updated>2026-10-02T05:00:00Z</updated>
      <link href="https://arxiv.org/pdf/2501.01234v2" rel="related"/><link href="https://arxiv.org/abs/2501.01234v2" rel="alternate"/><summary>s</summary></entry><entry><title>No link</title></entry></feed>""")
    (tmp_path / "r.xml").write_text("<rss><item><title>News</title><link>https://e.com/x?utm_source=1</link><pubDate>Fri, 02 Oct 2026 10:00:00 GMT</pubDate></item></rss>")
    atom = landed.read_feeds(spark, str(tmp_path / "a.xml"), "arxiv").collect()
    assert [(r["title"], r["url"], r["event_type"], r["event_at"]["at"]) for r in atom] == [("A title", "https://arxiv.org/abs/2501.01234v2", "paper-revision", dt.datetime(2026, 10, 2, 5))]
    rss = landed.read_feeds(spark, str(tmp_path / "r.xml"), "news", "rss").first()
    assert rss["url"] == "https://e.com/x" and rss["event_at"]["precision"] == "instant"


def test_payloads_and_metrics(spark, tmp_path):
    rows = [{"name": "v1", "html_url": "https://e.com/1", "published_at": "2026-10-02T00:00:00Z"}, {"name": "d", "html_url": "https://e.com/2", "draft": True}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, rows)))
    got = landed.read_api_payloads(spark, str(tmp_path / "p.json"), "release").collect()
    assert [r["title"] for r in got] == ["v1"] and got[0]["date_verified"]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, [{"at": "2026-10-02T00:00:00Z", "stage": "read", "role": "Not OK!", "duration_ms": -1, "count": 3, "x": 1}])))
    m = landed.read_metrics(spark, str(tmp_path / "m.json")).first()
    assert (m["stage"], m["role"], m["duration_ms"], m["count"]) == ("read", None, None, 3.0)


def test_assets_and_sinks(spark, tmp_path):
    (tmp_path / "img").mkdir()
    for name, data in (("a", b"\x89PNG\r\n\x1a\nxx"), ("b", b"\xff\xd8\xff\xe0"), ("c", b"<svg xmlns='x'/>"), ("d", b"RIFF1234WEBPVP8"), ("e", b"plain")):
        (tmp_path / "img" / name).write_bytes(data)
    assert {r["path"][-1]: r["kind"] for r in landed.read_assets(spark, str(tmp_path / "img")).collect()} == {"a": "png", "b": "jpg", "c": "svg", "d": "webp", "e": None}
    one = spark.createDataFrame([("2026-10-02", "x"), ("2026-10-03", "y")], "issue_date string, markdown string")
    landed.write_articles(one, str(tmp_path / "out"))
    landed.write_articles(one.filter("issue_date = '2026-10-03'").withColumn("markdown", F.lit("z")), str(tmp_path / "out"))
    assert sorted(r["markdown"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "z"]
    landed.append_audit(one, str(tmp_path / "log"))
    landed.append_audit(one, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


MD = "# Title\nfirst line\nsecond line\n\n- one\n- two\n```\n# code $x_1$\n```\n> said\n\n| a | b |\n| - | - |\n## References\n[1] A\n\n[2] B\n### More\nx\n## After\ncost $5 and $6, formula $a_1+b$ and `$c_1$`\n$$a_1+b$$\n"


def test_markdown_structure(spark):
    b = S.markdown_blocks(spark.createDataFrame([(1, MD)], "doc_id int, text string"))
    got = S.number_visuals(O.annotate_bibliography(b)).orderBy("ord").collect()
    assert [r["type"] for r in got] == ["heading", "paragraph", "list_item", "list_item", "code", "quote", "table", "heading", "reference", "reference", "heading", "reference", "heading", "paragraph", "equation"]
    assert [r["number"] for r in got if r["type"] == "reference"] == [1, 2, 1] and got[1]["text"] == "first line\nsecond line"
    cut = O.slice_sections(b, spark.createDataFrame([(1, "references", None)], "doc_id int, start string, end string")).orderBy("ord").collect()
    assert [r["text"] for r in cut] == ["References", "[1] A", "[2] B", "More", "x"]
    assert S.flatten_documents(b).first()["text"].startswith("Title\n\nfirst line")


def test_formulas(spark):
    f = S.extract_formulas(spark.createDataFrame([(1, MD), (2, "no $5 or $6"), (3, None)], "doc_id int, text string")).collect()
    assert [(r["doc_id"], r["kind"], r["tex"]) for r in f] == [(1, "display", "a_1+b")]  # the inline twin of the display formula is dropped
    bodies = spark.createDataFrame([(1, "a + b"), (1, "c")], "card_id int, tex string")
    assert [r["tex"] for r in S.ground_formulas(bodies, spark.createDataFrame([(1, "a+b")], "card_id int, tex string")).collect()] == ["c"]


def test_articles_and_units(spark):
    items = spark.createDataFrame([("d", 2, "B", "b\n\n\n\nc", []), ("d", 1, "A", "a", ["https://e.com"])], "issue_date string, ord int, heading string, body string, sources array<string>")
    assert S.assemble_articles(items).first()["markdown"] == "## A\n\na\n\nhttps://e.com\n\n## B\n\nb\n\nc"
    blocks = spark.createDataFrame([(1, 1, "paragraph", "t", None, None), (1, 2, "figure", None, "cap", None), (1, 3, "reference", "r", None, None), (1, 4, "quote", "q", None, "preserve-original")], "doc_id int, ord int, type string, text string, caption string, translation_policy string")
    assert sorted(r["unit_id"] for r in S.translation_units(blocks).collect()) == ["b1", "c2"]


def test_private_hosts(spark):
    urls = ["http://10.1.2.3/", "https://8.8.8.8/", "http://localhost:80", "https://e.com", "ftp://e.com", "http://172.31.0.1", "http://172.32.0.1", "https://u@e.com/", "http://x.local/"]
    got = {r["url"]: r["private"] for r in R.flag_private_hosts(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert [got[u] for u in urls] == [True, False, True, False, True, True, False, True, True]


def test_equivalence_of_translations(spark):
    u = spark.createDataFrame([(1, "GPT-5 costs 20 at https://e.com", "GPT-5 20 https://e.com"), (2, "two tests gave 3", "2 3"), (3, "3 runs", "4")], "unit_id int, source string, target string")
    rows = R.translation_equivalence(u).collect()
    assert {(r["unit_id"], r["token"], r["severity"]) for r in rows} == {(2, "NUM:2", "warning"), (3, "NUM:3", "error"), (3, "NUM:4", "error")}
    assert {r["unit_id"]: (r["errors"], r["warnings"]) for r in R.assess_units(R.translation_equivalence(u)).collect()} == {2: (0, 1), 3: (2, 0)}


def test_failures_and_receipts(spark):
    runs = spark.createDataFrame([("ECONNRESET", "x", False), ("TIMEOUT", "daily", False), ("TIMEOUT", "x", False), ("AUTH", "x", False), ("NETWORK", "x", True)], "code string, profile string, remote boolean")
    assert [(r["status"], r["retryable"]) for r in R.classify_failures(runs).collect()] == [("failed", True), ("failed", True), ("failed", False), ("needs_input", False), ("needs_review", False)]
    ops = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3")], "op_id int, identity string")
    seen = spark.createDataFrame([("old", "h1"), ("a", "h1"), ("b", "h2"), ("c", "h2")], "draft_id string, identity string")
    got = R.reconcile_receipts(ops, spark.createDataFrame([("old",)], "draft_id string"), seen)
    assert {r["op_id"]: (r["status"], r["draft_id"]) for r in got.collect()} == {1: ("resolved", "a"), 2: ("needs_review", None), 3: ("needs_review", None)}


def test_small_review_jobs(spark):
    docs = spark.createDataFrame([("10.1/A",), ("10.1/b",)], "doi string")
    fixes = spark.createDataFrame([("10.1/a", ["Retraction"]), ("10.1/b", ["erratum"])], "doi string, update_types array<string>")
    assert [r["doi"] for r in R.drop_retracted(docs, fixes).collect()] == ["10.1/b"]
    a = spark.createDataFrame([(1, "x", 5), (1, "x", 5), (1, "y", 6)], "article_id int, sha256 string, size long")
    assert R.asset_budget(a, total=11).first().asDict() == {"article_id": 1, "n": 3, "bytes": 11, "largest": 6, "fits": True}
    pages = spark.createDataFrame([(1, 1), (1, 3)], "doc_id int, page int")
    assert R.page_coverage(pages, spark.createDataFrame([(1, 4)], "doc_id int, page_count int")).first()["missing"] == [2, 4]
    items = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "draft_id int, item int")
    errors = spark.createDataFrame([(1, "item 2"), (1, "header"), (2, None)], "draft_id int, scope string")
    assert sorted(map(tuple, R.repair_targets(errors, items).collect())) == [(1, 2), (2, 1), (2, 2)]
    n = spark.createDataFrame([("C1:17.5",), ("k",)], "thread_key string")
    got = {r["thread_key"]: (r["channel"], r["root"]) for r in R.route_notices(n, spark.createDataFrame([("k", "C9", "1")], "thread_key string, channel string, root string")).collect()}
    assert got == {"C1:17.5": ("C1", "17.5"), "k": ("C9", "1")}


def test_unusable_pages(spark):
    p = spark.createDataFrame([("", "", 0, ""), ("Checking your browser", "", 0, ""), ("Log in to continue", "", 1, ""), ("x" * 10, "x", 1, "<div id='root'>"), ("y" * 900, "y" * 900, 9, "")], "visible string, article string, blocks int, html string")
    assert [r["reason"] for r in R.flag_unusable_pages(p).collect()] == ["empty", "challenge", "login-wall", "client-shell", None]
