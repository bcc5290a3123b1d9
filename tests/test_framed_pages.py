import random
import sys

import pytest

from groundwork.operators import pages as P


def order(key, items):
    rows = "".join(f"<tr>{f'<th rowspan={len(items)}>{key}</th>' if i == 0 else ''}<td>{i}<td colspan=2>{x}</td><td> {x}  y </td></tr>" for i, x in enumerate(items))
    return f"<article><table>{rows}</table></article>"


def whole(url, html):
    root = P.tree(html)
    meta = P.metadata(root, url)
    P.measured(root, meta["title"] or "")
    return P.blocks(P.content_root(root, meta["title"] or ""), url)


def test_a_small_page_takes_few_steps():
    pages = [order(k, ["a", "b", "c", "d"]) for k in range(50)]
    whole("", pages[0])
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = [whole("", html) for html in pages]
    finally:
        sys.setprofile(None)
    assert [b["rows"][0] for own in found for b in own] == [[str(k), "0", "a", "", "a y"] for k in range(50)]
    assert steps < 50 * 1000  # about 2,300 a page where tags were read letter by letter and nodes again and again


def test_pages_of_one_frame_are_read_once(monkeypatch):
    read, tree = [], P.tree
    monkeypatch.setattr(P, "tree", lambda html: read.append(html) or tree(html))
    P._frames.clear()
    pages = [order(k, draw) for k, draw in enumerate([["a"], ["b", "c"], ["d", "e", "f"]] * 30)]
    found = [P.page_blocks("", html) for html in pages]
    assert len(read) <= 2 * 3
    assert found == [whole("", html) for html in pages]


PAGES = (
    "<article><table><tr><td>{}</td><td>{}</td></tr><tr><td>{}</table><p>{}<b>{}</b></article>", "<body><div>{}</div><article><h2>{}</h2>{}<ul><li>{}<li value=7>{}</ul></article></body>", "<article><p>{}<br>{}</article><table><tr><td>{}{}</table>{}",
    "<article><h1>{}</h1><p>{}</p></article>", "<title>{}</title><article><h1>{}</h1><p>{}</p></article><div><h1>T</h1></div>", "<article><p><a href='#fn1'>{}</a>{}</p></article>", "<article><p>{}</p></article><article><p>{}</p><p>{}</p></article>", "<div><p>{}</p></div><div><p>{}</p></div>",
    "<article><figure><figcaption>{}</figcaption><table><tr><td>{}</table></figure></article>", "<article><pre>{}</pre><math>{}</math>{}</article>", "<article><table><caption>{}</caption><tr><td>{}</table></article>", "<article hidden><p>{}</p></article><article>{}</article>",
)


@pytest.mark.parametrize("page", PAGES)
def test_frames_give_what_each_page_gives(page):
    draw = random.Random(page)
    texts = ["", " ", "\n", "T", "3", "[3]", "a  b", " c ", "d\n\n e", "", "&amp;", "&nbsp;", "x &lt y", "\x1c", "<i>i</i>", "long " * 300]
    for _ in range(150):
        html = page.format(*[draw.choice(texts) for _ in range(page.count("{}"))])
        assert P.page_blocks("https://a.example/p", html) == whole("https://a.example/p", html), html


def test_blocks_of_null_pages_and_ids(spark):
    rows = [(None, None, order(7, ["a"])), ("x", "https://a.example/", None), ("y", None, "<article>" + "<p>t</p>" * 3)]
    got = P.extract_blocks(spark.createDataFrame(rows, "page string, url string, html string"), "page")
    assert sorted(((r["page"], r["ord"], r["type"], r["text"], r["rows"]) for r in got.collect()), key=str) == sorted([(None, 0, "table", "", [["7", "0", "a", "", "a y"]]), *[("y", i, "paragraph", "t", []) for i in range(3)]], key=str)
    assert got.columns == ["page", "ord", "type", "level", "text", "fragments", "caption", "bibliography_id", "rows", "images", "ordinal", "depth"]
    assert [(r["page"], r["url"], r["title"], len(r["blocks"])) for r in P.read_structure(spark.createDataFrame(rows, "page string, url string, html string"), "page").orderBy("page").collect()] == [(None, None, None, 1), ("x", "https://a.example/", None, 0), ("y", None, None, 3)]
