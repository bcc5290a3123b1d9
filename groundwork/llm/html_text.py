"""Main text of web pages: a linear-chain CRF over the leaf blocks of the DOM.

Each leaf block (the text between two block-level boundaries) has features of its ancestor tags, of
the words in their class and id, of its text, and of what the heading above and short lines say; the
chain tells article from the rest and is decoded by Viterbi over the whole page. Text of scripts,
styles, form controls and hidden elements is not part of any block; formulas and drawings are read as
text. Only white space, line breaks and cells part words.

The labelled pages are written by a seeded generator (``pages`` of them, many layouts, with menus,
headers, sidebars, notices, adverts, forms and comments around and inside the article); the weights
are trained on the driver.

Edge cases: null html is empty; a page without article blocks has an empty text; broken or cut-off
markup is read as far as it goes (heads, paragraphs, items and controls whose end tags are left out
end where the next block tells); an input column main_text is replaced; repeated rows are read alike; an empty table gives an empty table;
further columns pass through.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.crf import Crf, train
from groundwork.llm.html_blocks import SAID, Block, blocks, said
from groundwork.llm.text import whole

@dataclass(frozen=True)
class Pages:
    pages: int = 800
    epochs: int = 8
    seed: int = 5


_HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _linked(b: Block) -> bool:
    return b.linked >= 0.9 * len(b.text)


def _led(page: list[Block]) -> list[str]:
    """What the first block of each block's holder is like: a short line, one with a time, or no such."""
    out, first = [], {}
    for b in page:
        f = first.setdefault(b.holder, b)
        short = f.text.count(" ") < 6 and (f.text[-1] not in ".!?…:;" or f.text.count(" ") < 2) and f.leaf not in ("h1", "h2") and not _linked(f)
        kind = "time" if "time" in said(f.text) else "short" if short else "long"
        out.append(f"opens-{kind}" if f is b else kind)
    return out


def _sections(page: list[Block], told: list[frozenset[str]], led: list[str], most: int = 8) -> list[str]:
    """For each heading, what the blocks under it look like: things of one kind, each with a short line
    or a time first; links; or prose. Only a few blocks are looked at."""
    out = ["none"] * len(page)
    for i, b in enumerate(page):
        if b.leaf not in _HEADS:
            continue
        below = []
        for j in range(i + 1, min(len(page), i + 1 + most)):
            if page[j].leaf in ("h1", "h2", "h3") and page[j].kin < 2:
                break
            below.append(j)
        items = sum(page[j].kin > 1 and led[j] in ("time", "short") for j in below)
        if any("time" in told[j] and len(page[j].text) < 60 for j in below):
            out[i] = "time"
        elif below and 2 * sum(_linked(page[j]) for j in below) >= len(below):
            out[i] = "links"
        elif 3 * items >= len(below) and items:
            out[i] = "items"
        elif any(page[j].text.count(" ") >= 12 for j in below):
            out[i] = "prose"
        else:
            out[i] = "short"
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features of each block of a page. What a heading's words tell counts together with
    what stands under it, so that an article may have a part on reviews or comments."""
    out, total, heading = [], len(page), False
    told, led = [said(b.text) for b in page], _led(page)
    looks, size = _sections(page, told, led), Counter(b.holder for b in page)
    under, last, look = frozenset(), frozenset(), "none"  # what the heading above, and the short line before, tell
    for i, b in enumerate(page):
        n, words = len(b.text), b.text.count(" ") + 1
        link, kin = b.linked / max(n, 1), min(3, b.kin)
        is_head = b.leaf in _HEADS
        fs = ["bias", f"leaf:{b.leaf}", f"words:{min(6, words.bit_length())}", f"link:{0 if not b.linked else 1 if link < 0.4 else 2 if link < 0.9 else 3}"]
        fs += [f"in:{t}" for t in b.tags] + [f"is:{m}" for m in b.marks]
        fs += [f"near:{m}" for m in b.near] or ["near:none"]
        fs.append(f"inner:{b.inner}")
        fs.append(f"end:{'stop' if b.text[-1] in '.!?…:;\"”»' else 'open'}")
        if b.text.startswith(("©", "(c)", "Copyright")):
            fs.append("copyright")
        if i and page[i - 1].parent == b.parent:
            fs.append("same-parent")
        if link >= 0.5 and any(x in b.text for x in ("|", "·", "•", " - ", " / ")) and words < 16:
            fs.append("bar-of-links")
        fs += [f"kin:{kin}", f"led:{led[i]}", f"kin-led:{kin}:{led[i]}:{min(4, size[b.holder])}"]
        if not is_head:
            fs += [f"says:{m}" for m in told[i]]
        if is_head:
            under, look = told[i], looks[i]
            fs += [f"heads:{m}:{look}" for m in under] + [f"looks:{look}"]
        else:
            fs += [f"under:{m}:{look}" for m in under] + [f"after:{m}" for m in last] + [f"below:{look}"]
        last = told[i]
        fs.append(f"head:{heading}")
        heading = heading or b.leaf == "h1"
        fs.append(f"at:{min(3, 4 * i // total)}")
        if total == 1:
            fs.append("alone")
        out.append(fs)
    return out


_ARTICLE, _OTHER = 1, 0


class _Writer:
    """Labelled pages for training: html and the label of each of its leaf blocks, in order."""

    def __init__(self, seed: int):
        self.r, self.heads = random.Random(seed), random.Random(seed)  # heads of their own: they change no other draw
        self.labels: list[int] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choices(("an", "the", "re", "ti", "on", "er", "ble", "ing", "ou", "st", "de", "é", "chen", "ou", "mi", "ß", "ñ"), k=r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high).capitalize() + self.r.choice((".", ".", ".", "!", "?"))

    def put(self, label: int, html: str) -> str:
        self.labels.append(label)
        return html

    def links(self, n: int, cls: str) -> str:
        items = "".join(self.put(_OTHER, f'<li><a href="/{i}">{self.words(1, 2)}</a></li>') for i in range(n))
        return self.r.choice((f"<nav{cls}><ul>{items}</ul></nav>", f'<div class="{self.r.choice(("menu", "navbar", "breadcrumbs", "nav-links"))}"><ul>{items}</ul></div>'))

    def extra(self) -> str:
        r = self.r
        if r.random() < 0.4:
            return self.named_by_words()
        kind = r.randrange(9)
        s = lambda: self.sentence(3, 14)
        if kind == 0:
            return f'<div class="{r.choice(("ad", "ads", "advert", "sponsored", "promo-box"))}">{self.put(_OTHER, s())}</div>'
        if kind == 1:
            ps = "".join(self.put(_OTHER, f"<p>{s()}</p>") for _ in range(r.randint(1, 3)))
            return r.choice((f'<div class="{r.choice(("cookie-notice", "notice", "newsletter", "consent", "alert"))}">{ps}</div>', f'<div id="cookie-banner">{ps}</div>'))
        if kind == 2:
            ps = "".join(self.put(_OTHER, r.choice((f"<p>{s()}</p>", f'<li><a href="#">{self.words(2, 6)}</a></li>'))) for _ in range(r.randint(1, 5)))
            return r.choice((f"<aside>{ps}</aside>", f'<div class="sidebar">{ps}</div>', f'<aside class="related"><div>{ps}</div></aside>'))
        if kind == 3:
            return f'<form action="/s"><label>{self.put(_OTHER, self.words(1, 3))}</label><div>{self.put(_OTHER, self.words(1, 6))}</div><input name="q"><button>{self.words(1, 1)}</button></form>'
        if kind == 4:
            ps = "".join(self.put(_OTHER, f'<div class="comment"><p>{self.sentence(3, 30)}</p></div>') for _ in range(r.randint(1, 4)))
            return r.choice((f'<section id="comments">{ps}</section>', f'<div class="comments">{ps}</div>'))
        if kind == 5:
            return f'<div class="{r.choice(("share", "social", "tags", "related", "author-bio", "meta"))}">{self.put(_OTHER, self.words(1, 6))}</div>'
        if kind == 6:
            return f'<script>var a="<p>{self.words(1, 2)}</p>";</script><style>p{{}}</style>'
        if kind == 7:
            return f'<div class="{r.choice(("breadcrumb", "pagination", "toolbar", "login-box"))}">{self.put(_OTHER, self.words(1, 5))}</div>'
        return "<!-- note -->"

    def no_family(self) -> str:
        """A class that tells nothing."""
        return self.r.choice(("", f' class="{self.r.choice(("x", "c", "blk", "l", "u", "box", "wrap", "col", "row", "part", "unit"))}{self.r.randint(0, 99)}"'))

    def said(self, family: str, least: int, most: int) -> str:
        ws = [*(self.r.choice(SAID[family].split()) for _ in range(self.r.randint(1, 2))), *self.words(1, 3).split()[: self.r.randint(least, most)]]
        self.r.shuffle(ws)
        return " ".join(ws).capitalize()

    def time(self) -> str:
        r = self.r
        return r.choice((f"{r.randint(2, 20)} hours ago", f"{r.randint(2, 20)} days ago", f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.2024, {r.randint(10, 23)}:{r.randint(10, 59)}", f"vor {r.randint(2, 9)} Stunden", f"il y a {r.randint(2, 9)} jours", f"hace {r.randint(2, 9)} horas"))

    def named_by_words(self) -> str:
        """Comments, related links, notices and adverts that their words, not their classes, name."""
        r, family = self.r, self.r.choice(("talk", "talk", "talk", "share", "ad", "note", "form"))
        tag, outer, inner = r.choice(("h2", "h3", "h4")), r.choice(("section", "div")), self.no_family()
        told = r.random() < 0.65  # else what stands under the heading, if there is one, has to tell
        head = self.put(_OTHER, f"<{tag}>{self.said(family, 0, 2) if told else self.words(1, 3).capitalize()}</{tag}>") if told or r.random() < 0.6 else ""
        if family == "talk":
            items = []
            named, item = r.choice((0.2, 0.9)), r.choice(("<div{}>{}</div>", "<li{}>{}</li>", "<div{}>{}</div>"))
            for _ in range(r.randint(1, 4) if told else r.randint(2, 5)):
                if not told:  # things of one kind, each with who wrote it
                    by = self.put(_OTHER, f"<{(x := r.choice(('div', 'p', 'h5', 'h4', 'b', 'span')))}>{self.words(1, 2).title()}{r.choice((' ', ', ', ' · ')) + self.time() if r.random() < named else ''}</{x}>")
                    text = self.put(_OTHER, f"<p>{' '.join(self.sentence(3, 16) for _ in range(r.randint(1, 3)))}</p>")
                    items.append(item.format(inner, by + text))
                    continue
                by = self.put(_OTHER, f"<{(x := r.choice(('div', 'p', 'h5', 'b', 'span')))}>{self.words(1, 2).title()}{r.choice((' ', ', ', ' · ')) + self.time() if r.random() < named + 0.1 else r.choice(('', '', '.'))}</{x}>") if r.random() < 0.8 else ""
                text = self.put(_OTHER, f"<{(x := r.choice(('p', 'div', 'p')))}>{' '.join(self.sentence(3, 16) for _ in range(r.randint(1, 3)))}</{x}>")
                reply = self.put(_OTHER, f"<div>{r.choice(('Reply', 'Antworten', 'Répondre', 'Responder'))}</div>") if r.random() < 0.4 else ""
                items.append(item.format(inner, by + text + reply))
            body = "".join(items) if item.startswith("<div") or r.random() < 0.3 else f"<{(x := r.choice(('ul', 'ol')))}>{''.join(items)}</{x}>"
        elif family == "share":
            body = "<ul>" + "".join(self.put(_OTHER, f'<li><a href="/{i}">{self.words(2, 9)}</a></li>') for i in range(r.randint(1, 5))) + "</ul>"
        else:
            body = self.put(_OTHER, f"<p>{self.said(family, 1, 3)} {self.words(1, 2)}</p>") + self.put(_OTHER, f"<p>{self.sentence(2, 9)}</p>")
        return f"<{outer}{self.no_family()}>{head}{body}</{outer}>"

    def part(self) -> str:
        """A part of an article whose heading has such words: reviews, comments from someone, more on it."""
        r = self.r
        tag = r.choice(("h2", "h2", "h3"))
        head = self.put(_ARTICLE, f"<{tag}>{self.said(r.choice(('talk', 'talk', 'share', 'share', 'foot', 'nav', 'note')), 0, 3)}</{tag}>")
        return head + "".join(self.put(_ARTICLE, f"<p>{' '.join(self.sentence(5, 16) for _ in range(r.randint(1, 4)))}</p>") for _ in range(r.randint(1, 3)))

    def bar(self) -> str:
        """A line of links."""
        r = self.r
        mark = r.choice((" | ", " · ", " • ", " - ", " / "))
        ws = [r.choice(SAID["foot"].split() + SAID["nav"].split()).capitalize() if r.random() < 0.7 else self.words(1, 1) for _ in range(r.randint(2, 5))]
        tag = r.choice(("p", "div"))
        return self.put(_OTHER, f"<{tag}{self.no_family()}>{mark.join(f'<a href=/{w}>{w}</a>' for w in ws)}</{tag}>")

    def paragraph(self) -> str:
        r = self.r
        if r.random() < 0.03:  # articles have such words and times as well
            tag = r.choice(("p", "p", "h2"))
            return self.put(_ARTICLE, f"<{tag}>{r.choice((self.said(r.choice(tuple(SAID)), 2, 3), self.words(1, 3) + ' ' + self.time()))}{r.choice(('', '.'))}</{tag}>")
        text = r.choice((lambda: self.words(1, 5), lambda: self.sentence(1, 3), lambda: self.sentence(5, 20), lambda: " ".join(self.sentence(4, 16) for _ in range(r.randint(1, 6)))))()
        if r.random() < 0.1:
            text = text.replace(" ", "*** ", 3)
        if r.random() < 0.15:
            text = f'{text} <a href="/x">{self.words(1, 3)}</a> {self.words(1, 3)}.'
        kind = r.random()
        if kind < 0.72:
            return self.put(_ARTICLE, f"<p>{text}</p>")
        if kind < 0.77:
            return self.put(_ARTICLE, f"<h2>{self.words(1, 6)}</h2>")
        if kind < 0.82:
            return f"<ul>{''.join(self.put(_ARTICLE, f'<li>{self.words(1, 9)}</li>') for _ in range(r.randint(1, 4)))}</ul>"
        if kind < 0.86:
            return f"<blockquote>{self.put(_ARTICLE, f'<p>{text}</p>')}</blockquote>"
        if kind < 0.9:
            return f"<table>{''.join(self.put(_ARTICLE, f'<tr><td>{self.words(1, 2)}</td><td>{self.words(1, 2)}</td></tr>') for _ in range(r.randint(1, 3)))}</table>"
        if kind < 0.93:
            return self.put(_ARTICLE, f"<pre>{self.words(2, 9)}</pre>")
        if kind < 0.96:
            return f"<figure><img src='x'>{self.put(_ARTICLE, f'<figcaption>{self.words(2, 8)}</figcaption>')}</figure>"
        return self.put(_ARTICLE, f"<div>{text}</div>")

    def article(self) -> str:
        r = self.r
        head = self.put(_ARTICLE, f"<h1>{self.words(2, 9)}</h1>") if r.random() < 0.85 else ""
        body = []
        for _ in range(r.randint(1, 10)):
            body.append(self.paragraph())
            if r.random() < 0.12:
                body.append(self.extra())
            if r.random() < 0.08:
                body.append(self.part())
        if r.random() < 0.25:  # parts of their own, with headings
            cls = self.no_family()
            for i in range(0, len(body), 3):
                body[i : i + 3] = [f"<{(x := r.choice(('section', 'div')))}{cls}>{''.join(body[i : i + 3])}</{x}>", "", ""][: len(body[i : i + 3])]
        inside = head + "".join(body) + (self.extra() if r.random() < 0.2 else "") + (self.bar() if r.random() < 0.06 else "")
        return r.choice((
            f"<article>{inside}</article>", f"<main><article>{inside}</article></main>", f"<article>{inside}</article>", f"<main>{inside}</main>",
            f'<div class="{r.choice(("content", "post", "entry-content", "story-body", "article"))}">{inside}</div>', f'<div id="content"><div>{inside}</div></div>', f"<div>{inside}</div>",
        ))

    def page(self) -> tuple[str, list[int]]:
        r, self.labels = self.r, []
        if r.random() < 0.05:  # nothing but a text
            text = self.put(_ARTICLE, " ".join(self.sentence(2, 14) for _ in range(r.randint(1, 5))))
            return r.choice(("<div>{}</div>", "{}", "<body>{}</body>", "<p>{}</p>", "<html><body><div><div>{}</div></div></body></html>")).format(text), self.labels
        close = self.heads.choice(("</head><body>", "</head><body>", "<body>", ""))  # both tags may be left out
        parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{self.words(2, 6)}</title>{close}"]
        if r.random() < 0.4:
            parts.append(r.choice(("<header>{}</header>", '<div class="header">{}</div>', '<header><div class="logo">{}</div></header>')).format(self.put(_OTHER, self.words(1, 5))))
        if r.random() < 0.12:
            parts.append(self.bar())
        if r.random() < 0.85:
            parts.append(self.links(r.randint(1, 7), r.choice(("", ' class="menu"'))))
        for _ in range(r.randint(0, 3)):
            parts.append(self.extra())
        parts.append(self.article())
        for _ in range(r.randint(0, 3)):
            parts.append(self.extra())
        if r.random() < 0.85:
            foot = r.choice(("<footer>{}</footer>", "<footer><p>{}</p></footer>", '<div class="footer"><p>{}</p></div>', '<div id="colophon">{}</div>'))
            parts.append(foot.format(self.put(_OTHER, r.choice(("&copy; ", "")) + self.sentence(2, 12))))
        return "".join([*parts, r.choice(("</body></html>", ""))]), self.labels


def labelled(pages: int, seed: int) -> list[tuple[str, list[int]]]:
    w = _Writer(seed)
    return [w.page() for _ in range(pages)]


@lru_cache(maxsize=2)
def trained(p: Pages) -> tuple[Crf, dict[str, int]]:
    names: dict[str, int] = {}
    data = []
    for html, labels in labelled(p.pages, p.seed):
        seq = [[names.setdefault(f, len(names)) for f in fs] for fs in features(blocks(html))]
        assert len(seq) == len(labels), "the generator's labels and the reader's blocks differ"
        data.append((seq, labels))
    return train(data, len(names), 2, p.epochs), names


def main_blocks(html: str, model: tuple[Crf, dict[str, int]]) -> list[str]:
    """The texts of a page's article blocks, in order."""
    crf, names = model
    page = blocks(html)
    tags = crf.viterbi([[names[f] for f in fs if f in names] for fs in features(page)])
    return [b.text for b, tag in zip(page, tags, strict=True) if tag == _ARTICLE]


def extract(pages: DataFrame, p: Pages | None = None) -> DataFrame:
    """``pages`` with main_text. One scan, no shuffle."""
    model = trained(p or Pages())

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(main_blocks(x, model)) for x in html], dtype=object)

    return pages.withColumn("main_text", text(whole("html")))
