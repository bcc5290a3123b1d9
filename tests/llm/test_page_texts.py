"""Main text of pages that no generator of the library wrote: the given pages, read independently, and
the given articles in site frames written here, with class names that the tagger's training has not."""

from __future__ import annotations

import html
import re
import time

import pandas as pd
import pytest

from groundwork.llm import html_text
from groundwork.llm.html_blocks import blocks

ROOT = "/root/testdata/sf0.01/pages.parquet"

#: A frame has {head} and {body}; what stands outside of them is no article.
FRAMES = (
    '<html><head><title>t</title></head><body><div class="qz-top"><a href="/">Daily Planet</a></div><div class="qz-mid"><div class="kk1"><h1>{head}</h1>{body}</div></div><div class="qz-low"><p>&copy; 2024 Daily Planet. All rights reserved.</p></div></body></html>',
    '<html><body><nav role="navigation"><a href="/a">Home</a> <a href="/b">About</a></nav><main><h1>{head}</h1>{body}</main><section class="zz-op"><h2>12 comments</h2><div class="itm"><h5>jane22 - 3 hours ago</h5><p>I never saw anything like that before.</p></div><div class="itm"><h5>Karl, 2 days ago</h5><p>Well said.</p></div></section></body></html>',
    '<html lang=de><head><meta charset=utf-8><title>x</title><body><ul class="hauptmenue"><li><a href=1>Startseite</a><li><a href=2>Kontakt</a></ul><article><h1>{head}</h1>{body}</article><div class="leserbriefe"><h3>Kommentare</h3><ul><li><p>Sehr gut geschrieben, danke!</p></li></ul></div><p class="imp"><a href="/i">Impressum</a> <a href="/d">Datenschutz</a></p></body></html>',
    '<html><head><script>if (a < b) {{ document.write("<p>no</p>"); }}</script></head><body><header><a href="/">Site</a></header><div id="primary"><div class="hentry"><h1>{head}</h1>{body}</div><div class="jp-rel"><h3>Related posts</h3><ul><li><a href="/1">Another story of the week</a></li><li><a href="/2">And one more to look at</a></li></ul></div></div><aside><p>Popular this week</p></aside></body></html>',
    '<html><body><div><div class="gdpr-wall"><p>We use cookies to improve this site.</p><button>Accept<p>More about that</p></button></div></div><main class="m9"><article><header><h1>{head}</h1></header>{body}</article></main><footer><ul><li><a href="/t">Terms</a></li><li><a href="/p">Privacy</a></li></ul></footer></body></html>',
    '<html><body><table class="layout"><tr><td><div class="lnk"><a href="/1">Inicio</a></div><div class="lnk"><a href="/2">Contacto</a></div></td></tr></table><div class="cuerpo"><h1>{head}</h1>{body}</div><form action="/s"><label>Buscar</label><input name=q></form><div class="sus"><h4>Boletín</h4><p>Suscríbete para recibir noticias.</p></div></body></html>',
)


def read(page: str) -> tuple[str, list[str]]:
    """Heading and paragraphs of a given page, by its fixed frame: an article of an h1 and p's."""
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    head = re.search(r"<h1>(.*?)</h1>", inside, re.S)
    rest = inside[head.end() :]
    parts = re.split(r"</?p>", rest)
    plain = lambda x: " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].lower().startswith("<br") else "", x)).split())
    return plain(head[1]), [t for x in parts if (t := plain(x))]


def _score(pairs: list[tuple[list[str], list[str]]]) -> float:
    right = sum(len(set(a) & set(b)) for a, b in pairs)
    return 2 * right / (sum(len(set(a)) for a, _ in pairs) + sum(len(set(b)) for _, b in pairs))


@pytest.fixture(scope="module")
def given() -> list[tuple[str, tuple[str, list[str]]]]:
    return [(x, read(x)) for x in pd.read_parquet(ROOT)["html"]]


@pytest.fixture(scope="module")
def model():
    return html_text.trained(html_text.Pages())


def test_given_pages_are_read_whole(given, model):
    pairs = [(html_text.main_blocks(x, model), [head, *body]) for x, (head, body) in given]
    assert len(pairs) >= 200 and _score(pairs) >= 0.99
    assert sum(a == b for a, b in pairs) >= 0.97 * len(pairs)


@pytest.mark.parametrize("frame", range(len(FRAMES)))
def test_unseen_frames(given, model, frame):
    pairs = []
    for _, (head, body) in given[:80]:
        e = html.escape
        page = FRAMES[frame].format(head=e(head), body="".join(f"<p>{e(x)}</p>" for x in body))
        pairs.append((html_text.main_blocks(page, model), [head, *body]))
    assert _score(pairs) >= 0.95


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><article><h1>Head line of it</h1><p>Super<wbr>cali and a<img src=x>b and x<input>y stay whole here.</p></article>", "Supercali and ab and xy stay whole here."),
        ("<body><article><h1>Head line of it</h1><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, we stop at once.</p></article>", "Where x=2 holds, we stop at once."),
        ("<body><article><h1>Head line of it</h1><p>Some words of the text.</p><button>Go<p>After the button comes text.</p></article>", "After the button comes text."),
        ("<title>t</title><article><h1>Head line of it</h1><p>No head, no body &amp; no html &#8364; tags.</article>", "No head, no body & no html € tags."),
        ("<head><title>t</title><article><h1>Head line of it</h1><p>The head is never closed by anything.</p></article>", "The head is never closed by anything."),
    ],
)
def test_markup(model, page, want):
    assert want in html_text.main_blocks(page, model)


def test_depth_is_linear():
    deep = lambda n: "<div>" * n + "x" + "</div>y" * n
    begin = time.perf_counter()
    assert len(blocks(deep(20_000))) == 20_001
    assert time.perf_counter() - begin < 10
