import random
import time

from groundwork.operators import candidates as C
from groundwork.operators import pages as P

PAGE = """<html><head><title>T</title><meta name="author" content="Jo"><meta property="article:modified_time" content="2024-02-02">
<script type="application/ld+json">{"@graph": [{"@type": ["ScholarlyArticle"], "@id": "https://a.example/p#x", "datePublished": "2024-01-01"}]}</script></head>
<body><nav><p>menu</p></nav><article><h1>T</h1><p>One <b>bold<p>Two &amp; <a href="/x">link</a><sup><a href="#cite-3">[3]</a></sup>
<ul><li>a<ul><li>b</ul><li>c</ul><div class="social-share"><p>share</p></div>
<table><caption>Cap</caption><tr><th rowspan=2>r<th colspan=2>s</tr><tr><td>1<td>2</tr><tr><td></td></tr></table>
<figure><img data-src="i.png" alt=" an  image "><figcaption>Fig</figcaption></figure>
<section id="references"><p>Ref one</p></section><pre>x  y</pre></article><footer><p>foot</p></footer></body></html>"""


def rows(spark, html, url="https://a.example/p"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_blocks_in_order(spark):
    got = P.extract_blocks(rows(spark, PAGE)).orderBy("ord").collect()
    assert [(r["type"], r["text"]) for r in got] == [
        ("heading", "T"), ("paragraph", "One bold"), ("paragraph", "Two & ⟦001⟧⟦002⟧"), ("list_item", "a"), ("list_item", "b"), ("list_item", "c"), ("table", ""), ("figure", ""), ("paragraph", "Ref one"), ("code", "x  y"),
    ]
    assert [f.asDict() for f in got[2]["fragments"]] == [{"token": "⟦001⟧", "value": "[link](https://a.example/x)", "kind": "link"}, {"token": "⟦002⟧", "value": "[3]", "kind": "citation"}]
    assert got[6]["rows"] == [["r", "s", ""], ["r", "1", "2"]] and got[6]["caption"] == "Cap"
    assert got[7]["images"][0].asDict() == {"src": "https://a.example/i.png", "alt": "an image"}
    assert got[8]["bibliography_id"] == "references"


def test_metadata_by_priority(spark):
    r = P.page_metadata(rows(spark, PAGE)).first()
    assert (r["title"], r["author"], r["published"], r["modified"], r["scholarly"]) == ("T", "Jo", "2024-01-01", "2024-02-02", True)
    r = P.page_metadata(rows(spark, PAGE, "https://b.example/")).first()
    assert r["published"] is None and r["scholarly"]


def test_pages_without_anything(spark):
    for html in (None, "", "<p", "<table><tr>", "<!-- -->", "<html><body></body></html>", "</div></p>"):
        assert P.extract_blocks(rows(spark, html)).count() == 0
        assert P.page_metadata(rows(spark, html)).first()["title"] is None


def test_the_root_holds_the_title(spark):
    html = "<title>Head</title><body><div class=a><p>menu</p></div><div class=b><div><h1>Head</h1></div><p>text</p></div>"
    assert [r["text"] for r in P.extract_blocks(rows(spark, html)).orderBy("ord").collect()] == ["Head", "text"]


def shown(root):
    """The visible characters of a tree without tables and figures, in order."""
    return "".join(root.text(lambda n: n.drop).split())


def made(draw, deep=0):
    """Random markup: blocks in blocks, bare text beside them, phrases, lists, definitions, quotes."""
    word = lambda: draw.choice(["alpha", "βήτα", "x &amp; y", "漢字", "1.5", "<b>bold <i>both</i></b>", "end<br>line", '<a href="/u">link</a>', "<span>s<span>t</span></span>"])
    text = lambda: " ".join(word() for _ in range(draw.randrange(1, 4)))
    if deep > 5:
        return text()
    out = []
    for _ in range(draw.randrange(1, 5)):
        tag = draw.choice(["", "", "p", "div", "section", "li", "ul", "ol", "blockquote", "dl", "details", "h2", "pre", "b", "article", "center"])
        inner = text() if tag in ("p", "h2", "pre") else "".join(f"<li>{made(draw, deep + 1)}</li>" for _ in range(3)) if tag in ("ul", "ol") else f"<dt>{text()}</dt><dd>{made(draw, deep + 1)}</dd>" if tag == "dl" else f"<summary>{text()}</summary>{made(draw, deep + 1)}" if tag == "details" else made(draw, deep + 1)
        out.append(f"<{tag}>{inner}</{tag}>" if tag else f" {text()} ")
    return "".join(out)


def test_no_visible_character_is_lost():
    draw = random.Random(5)
    for _ in range(400):
        root = P.tree(f"<body><main>{made(draw)}</main></body>")
        P.measured(root, "")
        main = root.first("main")
        got = []
        for b in P.blocks(main, "https://a.example/"):
            text = b["text"]
            for f in b["fragments"]:
                text = text.replace(f["token"], f["value"].replace("[link](https://a.example/u)", "link"))
            got.append(text)
        assert sorted("".join("".join(got).split())) == sorted(shown(main))


def test_deep_and_wide_markup_in_linear_time():
    texts = {
        "phrases": "<p>" + "<b>" * 5000 + "deep" + "</b>" * 5000 + "<p>next</p>" * 3000, "blocks": "<div>" * 5000 + "deep" + "</div>" * 5000, "open": "<i>" * 5000 + "<p>one</p></u>" * 5000,
        "lists": "<ul><li>a" * 3000 + "</ul>" * 3000, "text": "<div>t " * 3000 + "</div>u " * 3000, "tables": "<table><tr><td>c" * 300, "links": '<a href="x"><div>' * 2000 + "in",
    }
    for name, html in texts.items():
        begin = time.perf_counter()
        root = P.tree(html)
        meta = P.metadata(root, "https://a.example/")
        P.measured(root, meta["title"] or "")
        assert P.blocks(P.content_root(root, meta["title"] or ""), "https://a.example/")
        assert time.perf_counter() - begin < 2, name


def test_text_beside_blocks(spark):
    html = """<body><article class="post-content-body social-science comments-open"><h1>T</h1>bare <b>text</b><div>in a div<p>x</p>tail</div><dl><dt>term<dd>told</dl>
    <blockquote>said<p>more</p></blockquote><details><summary>sum</summary>rest</details><ol start="4"><li>four<ul><li>in</ul>after<li value="9">nine<li>ten</ol><ol reversed><li>b<li>a</ol>
    <figure><div><img src="i.png"><figcaption>Cap</figcaption></div><p>note</p></figure><p>see <img src="j.png" alt="J"> it</p><math display="block" alttext="x^2"></math>
    <iframe src="https://www.youtube.com/embed/1" title="Talk"></iframe><h2 aria-label="Spelled"><span aria-hidden="true">S</span>pelled</h2></article></body>"""
    got = P.extract_blocks(rows(spark, html)).orderBy("ord").collect()
    assert [(r["type"], r["text"] or r["caption"], r["ordinal"], r["depth"]) for r in got] == [
        ("heading", "T", None, None), ("paragraph", "bare text", None, None), ("paragraph", "in a div", None, None), ("paragraph", "x", None, None), ("paragraph", "tail", None, None), ("paragraph", "term", None, None), ("paragraph", "told", None, None),
        ("quote", "said\nmore", None, None), ("paragraph", "sum", None, None), ("paragraph", "rest", None, None), ("list_item", "four\nafter", 4, 0), ("list_item", "in", None, 1), ("list_item", "nine", 9, 0), ("list_item", "ten", 10, 0),
        ("list_item", "b", 2, 0), ("list_item", "a", 1, 0), ("figure", "Cap", None, None), ("paragraph", "note", None, None), ("paragraph", "see it", None, None), ("figure", "", None, None), ("equation", "x^2", None, None), ("paragraph", "⟦001⟧", None, None), ("heading", "Spelled", None, None),
    ]
    assert got[-2]["fragments"][0]["value"] == "[Talk](https://www.youtube.com/embed/1)"


def test_roots_by_their_sums(spark):
    prose = "<p>" + "words of the text " * 20 + "</p>"
    cases = {
        f"<body><div><h1>Head</h1>{prose * 3}<h2>s</h2></div><article><p>teaser</p></article></body>": ["Head", "s"],
        f"<body><div id=menu>{'<a href=x>menu</a> ' * 90}</div><div id=text>{prose * 2}</div></body>": [],
        "<body>only text</body>": ["only text"], "<div>one div of prose</div>": ["one div of prose"], "<head><title>T</title><body>text": ["text"],
        "<body><header>top</header><div>kept</div><footer>foot</footer></body>": ["kept"],
    }
    for html, want in cases.items():
        got = [r["text"] for r in P.extract_blocks(rows(spark, html)).orderBy("ord").collect()]
        assert [g for g in got if not g.startswith("words of")] == want, html


def test_code_hosts_are_matched_on_owner_and_repository(spark):
    urls = spark.createDataFrame([(1, "https://code.example/Own/Rep/issues"), (2, "https://code.example/own/other"), (3, "https://www.sub.site.example/"), (4, "https://code.example/"), (1, "https://code.example/Own/Rep/issues")], "id int, url string")
    catalog = spark.createDataFrame([("rep", "code.example/own/rep", 2), ("own", "code.example/own", 3), ("site", "site.example", 1), ("host", "code.example", 0)], "profile_id string, domain string, ord int")
    got = sorted((r["id"], r["profile_id"]) for r in C.attach_profile(urls, catalog, code_hosts=["code.example"]).collect())
    assert got == [(1, "rep"), (1, "rep"), (2, "own"), (3, "site"), (4, None)] or got[:4] == [(1, "rep"), (1, "rep"), (2, "own"), (3, "site")]


def test_addresses_are_normalised(spark):
    from groundwork.functions.columns import canonical_url
    from pyspark.sql import functions as F

    cases = {"HTTPS://A.example:443/a/./b/../c?utm_source=x&q=1#f": "https://a.example/a/c?q=1", "http://a.example:80": "http://a.example/", "https://a.example:8080/..": "https://a.example:8080/", "https://a.example/a/b/..": "https://a.example/a/", "https://a.example/a..b/": "https://a.example/a..b/"}
    d = spark.createDataFrame([(k, v) for k, v in cases.items()], "k string, v string")
    assert [(r["k"], r["c"]) for r in d.select("k", "v", canonical_url(F.col("k")).alias("c")).filter("c <> v or c is null").collect()] == []
