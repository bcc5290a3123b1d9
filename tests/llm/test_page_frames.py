"""Main text on pages of 20 frames in two families that no training page has: sites whose class names
tell nothing and sites of plain old markup; with article parts that sound like something else, and
reader comments that nothing but their form tells."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from groundwork.llm import html_text
from test_page_texts import ROOT, read

TOP = ('<div class="a1"><a href="/">The Site</a></div>', '<ul class="k3"><li><a href="/x">World</a></li><li><a href="/y">Sport</a></li><li><a href="/z">Money</a></li></ul>', "<center><a href=1>Start</a> - <a href=2>Archive</a> - <a href=3>Links</a></center><hr>", '<header class="t"><p>A paper for the valley</p></header>', "")
#: Reader comments and the like: all of it is no article. {0} and {1} are texts.
AFTER = (
    '<div class="q7"><div class="q8"><b>Ana</b><p>{0}</p></div><div class="q8"><b>Rob K.</b><p>{1}</p></div><div class="q8"><b>Lia</b><p>{0}</p></div></div>',
    '<section><h3>3 thoughts on this</h3><ol><li><div>tom writes: 2024-03-01</div><p>{0}</p></li><li><div>ada writes: 2024-03-02</div><p>{1}</p></li></ol></section>',
    '<h4>Opiniones</h4><ul class="z"><li><p>Marta · hace 2 horas</p><p>{0}</p></li><li><p>Luis · hace 3 horas</p><p>{1}</p></li></ul>',
    '<div class="m5"><h3>Read next</h3><ul><li><a href="/1">A bridge too far</a></li><li><a href="/2">What the town wants</a></li><li><a href="/3">Ten ways home</a></li></ul></div>',
    '<p class="e2"><a href="/t">Terms</a> | <a href="/p">Privacy</a> | <a href="/c">Contact</a></p>',
    '<div class="w1"><p>Subscribe to our newsletter</p><form><input name=e><button>Go</button></form></div>',
)
#: Parts that belong to the article. {0} is a text.
PARTS = ("<h2>Reviews</h2><p>{0}</p>", "<h2>Comments from the council</h2><p>{0}</p>", "<h3>Related work</h3><p>{0}</p>", "<h3>More about the method</h3><ul><li>{0}</li></ul>", "<h2>Discussion</h2><p>{0}</p>", "<h2>Legal terms of the deal</h2><p>{0}</p>")
NEW = (
    '<html><body>{top}<div class="b9"><div class="c2"><h1>{head}</h1>{body}</div>{after}</div></body></html>', "<html><body>{top}<article><h1>{head}</h1>{body}</article>{after}</body></html>",
    '<html><body>{top}<main class="g"><section class="h"><h1>{head}</h1></section><section class="i">{body}</section></main>{after}</body></html>', '<html><body><div id="app1">{top}<div class="row2"><div class="col8"><h1>{head}</h1>{body}</div><div class="col4">{after}</div></div></div></body></html>',
    '<html><body>{top}<div role="main"><div class="xx"><h1>{head}</h1><div class="yy">{body}</div></div></div>{after}</body></html>',
)
OLD = (
    "<HTML><BODY>{top}<H1>{head}</H1>{body}<HR>{after}</BODY></HTML>", "<html><body bgcolor=white><table width=600><tr><td>{top}</td><td><h1>{head}</h1>{body}</td></tr></table>{after}</body></html>",
    "<body>{top}<div><h1>{head}</h1>{body}</div>{after}", "<html><body>{top}<blockquote><h1>{head}</h1>{body}</blockquote>{after}</body></html>", "<html><body><center><table><tr><td><h1>{head}</h1>{body}</td></tr><tr><td>{after}</td></tr></table></center></body></html>",
)
SAID = ("I think that it is far too early to tell what will come of it.", "Well written, and I hope that they will read it.", "Who is going to pay for all of that?", "We went there last year and it was not like that at all.")


@pytest.fixture(scope="module")
def model():
    return html_text.trained(html_text.Pages())


def made(family, seed, n):
    draw, given = random.Random(seed), [read(x) for x in pd.read_parquet(ROOT)["html"]]
    for i in range(n):
        head, paras = given[draw.randrange(len(given))]
        paras = [p for p in paras if len(p) > 60][:8] or paras[:3]
        want, body = [head], []
        for p in paras:
            body.append(f"<p>{p.replace('<', '&lt;')}</p>")
            want.append(p)
            if draw.random() < 0.2:
                part, text = draw.choice(PARTS), given[draw.randrange(len(given))][1][0]
                body.append(part.format(text.replace("<", "&lt;")))
                want += [part.split(">")[1].split("<")[0], text]
        after = "".join(draw.sample(AFTER, draw.randrange(3))).format(draw.choice(SAID), draw.choice(SAID))
        yield family[i % len(family)].format(top=draw.choice(TOP), head=head.replace("<", "&lt;"), body="".join(body), after=after), want


def overlap(model, pages):
    right = said = there = 0
    for page, want in pages:
        got = html_text.main_blocks(page, model)
        right += len(set(got) & set(want))
        said += len(set(got))
        there += len(set(want))
    return 2 * right / (said + there)


@pytest.mark.parametrize("family", [NEW, OLD])
def test_families_that_training_has_not_seen(model, family):
    assert overlap(model, list(made(family, 12, 100))) >= 0.95


def test_parts_of_an_article_stay(model):
    text = "The council met on Tuesday to look at the plan for the bridge, and many people of the town came to hear it."
    for part in PARTS:
        page = f"<body><article><h1>The bridge of the town</h1><p>{text}</p><p>{text[:60]}.</p>{part.format(text[5:])}</article></body>"
        assert text[5:] in html_text.main_blocks(page, model), part


@pytest.mark.parametrize("page", ["<div>{}</div>", "{}", "<body>{}</body>", "<article><p aria-hidden='true'>{}</p></article>"])
def test_pages_of_one_text(model, page):
    text = "One text that says a thing or two about the town and its bridge."
    assert html_text.main_blocks(page.format(text), model) == [text]
