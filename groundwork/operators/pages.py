"""Pages of any markup: metadata, content root, typed blocks, inline fragments, table grids.

Each page is read where it stands, in batches, by one pass over its markup into a small tree; what
the tree gives are rows, and everything after that is DataFrame work. No page moves.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements and class names that are no content.
SKIPPED = frozenset("script style noscript nav form aside video audio iframe template".split())
UNWANTED = frozenset("advertisement advert ads related-posts recommended comments cookie-banner newsletter-signup social-share".split())
#: Hosts whose frames are videos, and the label of a frame without a title.
VIDEO_HOSTS, VIDEO = frozenset(("youtube.com", "youtu.be", "vimeo.com", "player.vimeo.com")), "原文视频"
#: Most columns and rows that a cell may span.
MOST_COLUMNS, MOST_ROWS = 50, 200
#: What the first container of the title's heading must hold to be the content.
LEAST_TEXT, LEAST_PARAGRAPHS, LEAST_HEADINGS, MANY_PARAGRAPHS = 800, 3, 2, 6
#: A block counts as so many characters when articles are compared.
BLOCK_WORTH = 80
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
KINDS = {**dict.fromkeys(HEADINGS, "heading"), "p": "paragraph", "li": "list_item", "blockquote": "quote", "pre": "code", "table": "table", "figure": "figure", "math": "equation", "img": "figure"}
_ENDS_P = (frozenset(KINDS) - {"math", "img"}) | frozenset("article div section main ul ol dl header footer hr address details fieldset center".split())
#: Elements that stand on lines of their own; what is inline beside them is a paragraph without a tag.
BLOCK = _ENDS_P | frozenset("html head body nav form aside dt dd summary legend figcaption caption thead tbody tfoot tr td th".split())
_ON_LINES = BLOCK | {"img"}
#: Elements that may be no content without an attribute that says so.
_TOLD_BY_TAG = SKIPPED | {"head", "title", "header", "footer"}
CONTAINERS = frozenset("div section main article td".split())
#: Elements that end an open one like them.
_ENDS_LIKE = frozenset(("li", "td", "th", "tr", "dt", "dd"))
_IN_HEAD = frozenset("base link meta title style script noscript template".split())
_BIB = frozenset("references bibliography ref-list biblist ltx_bibliography doc-bibliography".split())
_NOTE_ANCHOR = re.compile(r"(?i)#(?:bib|ref|cite|fn|note|footnote)[\w.:-]*$")


class Node:
    """An element; ``inside`` has its texts and elements in order. What ``measured`` sets: drop (no
    content), block (something that stands on lines of its own is inside). What ``_summed`` sets: size
    and linked (characters of its text, and of that in links), paragraphs, headings, worth (blocks).
    A page's root has ``order``, its nodes as ``walk`` gives them, and ``seen``, their tags."""

    drop = block = False
    size = linked = paragraphs = headings = worth = 0
    order: list[Node]
    seen: dict[str, int]

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.inside = tag, attrs, up, []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [x for x in reversed(n.inside) if isinstance(x, Node)]

    def first(self, *tags: str) -> Node | None:
        todo = [self]
        while todo:
            n = todo.pop()
            if n.tag in tags:
                return n
            todo += [x for x in reversed(n.inside) if x.__class__ is Node]
        return None

    def text(self, skip: Callable[[Node], bool] = lambda n: False) -> str:
        if len(self.inside) == 1 and isinstance(self.inside[0], str) and self.tag != "br":
            return self.inside[0]
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag == "br":
                out.append("\n")
            elif x is self or not skip(x):
                todo += reversed(x.inside)
        return "".join(out)

    def names(self) -> set[str]:
        return {*self.attrs.get("class", "").split(), self.attrs.get("id", ""), self.attrs.get("role", "")}


class _Builder:
    """Builds the tree. ``open`` counts the open elements by tag, so that what cannot be closed is not
    looked for."""

    def __init__(self):
        self.root = self.at = Node("", {}, None)
        self.order, self.open = [self.root], {}
        self.root.order, self.root.seen = self.order, self.open

    def _up_to(self, n: Node) -> None:
        while self.at is not n:
            self.open[self.at.tag] -= 1
            self.at = self.at.up

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        opened = self.open
        if opened.get("head") and tag not in _IN_HEAD:  # a head that was never closed
            n = self.at
            while n.tag != "head":
                n = n.up
            self._up_to(n.up)
        if tag in _ENDS_P and opened.get("p"):
            p = self.at  # an open paragraph ends, with the phrases in it that were never closed
            while p.up is not None and p.tag != "p" and p.tag not in _ENDS_P and p.tag not in ("td", "th"):
                p = p.up
            if p.tag == "p":
                self._up_to(p.up)
        if tag in _ENDS_LIKE:
            at = self.at
            if tag == at.tag:
                self._up_to(at.up)
            elif (tag == "dt" and at.tag == "dd") or (tag == "dd" and at.tag == "dt") or (tag in ("td", "th") and at.tag in ("td", "th")):
                self._up_to(at.up)
            elif tag == "tr" and at.tag in ("td", "th"):
                self._up_to(at.up.up if at.up.tag == "tr" else at.up)
        at = self.at
        n = Node(tag, attrs, at)
        at.inside.append(n)
        self.order.append(n)
        if tag in VOID:
            opened.setdefault(tag, 0)
        else:
            self.at = n
            opened[tag] = opened.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        n = self.at
        if n.tag == tag and n.up is not None:
            self.open[tag] -= 1
            self.at = n.up
        elif self.open.get(tag):
            while n.tag != tag:
                n = n.up
            self._up_to(n.up)


class _Tree(HTMLParser):
    """Reads any markup."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.built = _Builder()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.built.start(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.built.end(tag)

    def handle_data(self, data: str) -> None:
        self.built.at.inside.append(data)


#: Tags and comments in plain form, which end at their first >, whatever stands around them.
_PLAIN = re.compile(r"""(<(?:[a-zA-Z][a-zA-Z0-9-]*(?:[ \t\r\n\f]+[a-zA-Z_:][a-zA-Z0-9_:.-]*(?:="[^"<>]*"|='[^'<>]*'|=[^ \t\r\n\f"'<>=`]+)?)*[ \t\r\n\f]*/?|/[a-zA-Z][a-zA-Z0-9-]*[ \t\r\n\f]*|!(?i:doctype)[^<>]*|!--[^<>-]*(?:-[^<>-]+)*--)>)""")
_START, _EMPTY, _RAW, _END, _NOTHING = range(5)


class _Read(HTMLParser):
    """Tells what one tag is."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str, dict[str, str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.found.append((_START, tag, {k: v or "" for k, v in attrs}))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.found.append((_START if tag in VOID else _EMPTY, tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        self.found.append((_END, tag, {}))

    def handle_data(self, data: str) -> None:
        raise ValueError(data)


#: Tags that are kept as they were read, and characters of the longest of them.
MOST_TAGS, LONGEST_TAG = 8192, 200


@functools.lru_cache(MOST_TAGS)
def _read(token: str) -> tuple[int, str, dict[str, str]]:
    """What a tag in plain form is: kind, name and attributes, which are not to be changed."""
    r = _Read()
    r.feed(token)
    kind, tag, attrs = r.found[0] if r.found else (_NOTHING, "", {})
    return (_RAW if r.cdata_elem else kind), tag, attrs


def _told(token: str) -> tuple[int, str, dict[str, str]]:
    return _read(token) if len(token) <= LONGEST_TAG else _read.__wrapped__(token)


def _plain_tree(html: str) -> Node | None:
    """The tree of a page all of whose tags are in plain form; none of another."""
    parts = _PLAIN.split(html)
    if "<" in "".join(parts[::2]):
        return None
    b = _Builder()
    start, end, raw, script = b.start, b.end, "", []
    for i, x in enumerate(parts):
        if i % 2 and raw:  # what looks like a tag in a script is none
            if _told(x)[:2] != (_END, raw):
                script.append(x)
                continue
            if any(script):
                b.at.inside.append("".join(script))
            raw, script = "", []
        if i % 2:
            kind, tag, attrs = _told(x)
            if kind == _START:
                start(tag, attrs)
            elif kind == _END:
                end(tag)
            elif kind == _EMPTY:
                start(tag, attrs)
                end(tag)
            elif kind == _RAW:
                start(tag, attrs)
                raw = tag
        elif raw:
            script.append(x)
        elif x:
            b.at.inside.append(unescape(x) if "&" in x else x)
    return None if raw else b.root


def tree(html: str) -> Node:
    root = _plain_tree(html or "")
    if root is not None:
        return root
    t = _Tree()
    t.feed(html or "")
    if re.match(r"</?[A-Za-z]", t.rawdata):  # a tag that the page ends in
        t.rawdata = ""
    t.close()
    return t.built.root


def flat(text: str) -> str:
    return " ".join(text.split())


def lines(text: str) -> str:
    return "\n".join(x for y in text.split("\n") if (x := flat(y)))


def _unwanted(n: Node) -> bool:
    return n.drop


def _above(n: Node) -> Iterator[Node]:
    while (n := n.up) is not None:
        yield n


def _no_content(n: Node, titled: set[int]) -> bool:
    if n.tag in SKIPPED or n.tag in ("head", "title"):
        return True
    if id(n) in titled:  # what holds the title is content, whatever its names say
        return False
    a = n.attrs
    return "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower() or (n.tag in ("header", "footer") and n.up is not None and n.up.tag in ("body", "html", "")) or a.get("id") == "comments" or not UNWANTED.isdisjoint(a.get("class", "").split())


def _mended(root: Node) -> None:
    """Frames of videos become paragraphs with a link; a heading that hides its letters from readers
    has the label that it gives them."""
    if "iframe" not in root.seen and HEADINGS.isdisjoint(root.seen):
        return
    changed = False
    for n in root.order:
        if n.tag == "iframe" and "src" in n.attrs:
            src = n.attrs["src"].strip()
            try:
                host = (urlsplit("https:" + src if src.startswith("//") else src).hostname or "").removeprefix("www.")
            except ValueError:
                continue
            if host in VIDEO_HOSTS:
                link = Node("a", {"href": src}, n)
                link.inside = [flat(n.attrs.get("title", "")) or VIDEO]
                n.tag, n.attrs, n.inside, changed = "p", {}, [link], True
        elif n.tag in HEADINGS and flat(n.attrs.get("aria-label", "")) and any(x.attrs.get("aria-hidden") == "true" for x in n.walk()):
            n.inside, changed = [flat(n.attrs["aria-label"])], True
    if changed:
        root.order = list(root.walk())


def measured(root: Node, title: str) -> None:
    """Sets what each node says of what is below it: what is no content on the way down, what stands on
    lines of its own on the way up."""
    _mended(root)
    head = next((n for n in root.order if n.tag == "h1" and flat(n.text()) == title), None) if title and "h1" in root.seen else None
    titled = {id(p) for p in _above(head)} if head else set()
    for n in root.order[1:]:
        if n.up.drop or ((n.attrs or n.tag in _TOLD_BY_TAG) and _no_content(n, titled)):
            n.drop = True
    for n in reversed(root.order):  # each after all that is below it
        if not n.drop and n.up is not None and (n.block or n.tag in _ON_LINES or _displayed(n)):
            n.up.block = True


def _summed(root: Node) -> None:
    """Sets the sums of each node over what is below it."""
    for n in reversed(root.order):  # each after all that is below it
        if n.drop:
            continue
        n.size += sum(len(flat(x)) for x in n.inside if isinstance(x, str))
        if n.tag == "a":
            n.linked = n.size
        n.paragraphs += n.tag == "p"
        n.headings += n.tag in HEADINGS
        n.worth += n.tag in ("p", "figure", "table", "pre") or n.tag in HEADINGS
        if n.up is not None:
            up = n.up
            up.size, up.linked, up.paragraphs, up.headings, up.worth = up.size + n.size, up.linked + n.linked, up.paragraphs + n.paragraphs, up.headings + n.headings, up.worth + n.worth


def _displayed(n: Node) -> bool:
    return n.tag == "math" and n.attrs.get("display") == "block"


def _plain(title: str) -> str:
    return flat(title).casefold()


def content_root(root: Node, title: str) -> Node:
    """What has the content of a measured tree: the first container around the title's heading that
    has enough text and blocks; else the only article; else the lowest container of most of the text
    outside links, which the title's heading stands in if there is one; else main; else the richest
    article; else the body."""
    kept = [n for n in root.order if not n.drop]
    heads = [n for n in kept if n.tag == "h1"]
    said = _plain(title)
    head = next((n for n in heads if said and (own := _plain(n.text())) and (own in said or said in own)), heads[0] if len(heads) == 1 else None)
    articles = [n for n in kept if n.tag == "article"]
    if head is None and len(articles) == 1:
        return articles[0]
    _summed(root)
    around = [p for p in _above(head) if p.tag not in ("body", "html", "")] if head else []
    held = next((p for p in around if p.size >= LEAST_TEXT and p.paragraphs >= LEAST_PARAGRAPHS and (p.headings >= LEAST_HEADINGS or p.paragraphs >= MANY_PARAGRAPHS)), None)
    if held or len(articles) == 1:
        return held or articles[0]
    body = next((n for n in kept if n.tag == "body"), root)
    prose, most, least = body.size - body.linked, None, 1 / 2 if around else 3 / 4
    for n in around or kept:
        if n.tag in CONTAINERS and n.size - n.linked > least * prose and n.paragraphs and (most is None or n.size < most.size):
            most = n
    main = next((n for n in kept if n.tag == "main" or n.attrs.get("role") == "main"), None)
    return most or main or max(articles, key=lambda n: n.size + BLOCK_WORTH * n.worth, default=None) or body


#: What says a field, first to last: (tag, attribute, value, the attribute with the content; none: the text).
FIELDS = {
    "title": (("meta", "property", "og:title", "content"), ("meta", "name", "twitter:title", "content"), ("title", "", "", ""), ("h1", "", "", "")),
    "author": (("meta", "name", "author", "content"), ("meta", "property", "article:author", "content"), ("", "rel", "author", ""), ("", "class", "author", "")),
    "published": (("meta", "property", "article:published_time", "content"), ("meta", "name", "date", "content"), ("time", "datetime", "", "datetime")),
    "modified": (("meta", "property", "article:modified_time", "content"), ("meta", "property", "og:updated_time", "content")),
}


def _said(root: Node, rules: tuple) -> str | None:
    for tag, attr, value, content in rules:
        if tag and tag not in root.seen:
            continue
        for n in root.order:
            if (not tag or n.tag == tag) and (not attr or (attr in n.attrs and (not value or value in n.attrs[attr].split()))):
                text = flat(n.attrs.get(content, "") if content else n.text())
                if text:
                    return text
    return None


def _records(value: object) -> Iterator[dict]:
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            yield x
            todo += list(x.values())
        elif isinstance(x, list):
            todo += x


def _is(record: dict, kind: str) -> bool:
    t = record.get("@type")
    return kind in (t if isinstance(t, list) else [t])


def metadata(root: Node, url: str) -> dict:
    """Fields of a page; a JSON-LD record counts for dates and author only if it says the page's URL."""
    out = {k: _said(root, rules) for k, rules in FIELDS.items()}
    scholarly = "meta" in root.seen and any(n.tag == "meta" and n.attrs.get("name", "").lower() in ("citation_title", "citation_doi") for n in root.order)
    for n in root.order if "script" in root.seen else ():
        if n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            try:
                records = list(_records(json.loads(n.text())))
            except ValueError:
                continue
            scholarly = scholarly or any(_is(r, "ScholarlyArticle") for r in records)
            own = next((r for r in records if any(isinstance(r.get(k), str) and urldefrag(urljoin(url, r[k]))[0] == urldefrag(url)[0] for k in ("@id", "url", "mainEntityOfPage"))), None)
            for k, name in (("published", "datePublished"), ("modified", "dateModified")):
                if own and isinstance(own.get(name), str):
                    out[k] = own[name]
    return {**out, "scholarly": scholarly}


def rich(inside: list[Node | str], url: str, skip: Callable[[Node], bool]) -> tuple[str, list[dict]]:
    """The text of what is ``inside`` with numbered tokens in place of links and formulas, and the
    tokens. What stands on lines of its own is on lines of its own."""
    fragments: list[dict] = []

    def token(value: str, kind: str) -> str:
        fragments.append({"token": f"⟦{len(fragments) + 1:03d}⟧", "value": value, "kind": kind})
        return fragments[-1]["token"]

    out: list[str] = []
    todo: list[Node | str] = list(reversed(inside))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        elif x.drop or skip(x):
            out.append("\n" if skip(x) and x.tag in BLOCK else "")
        elif x.tag == "math":
            out.append(token(x.attrs.get("alttext") or flat(x.text()), "math"))
        elif x.tag == "a" and "href" in x.attrs and not x.block:
            label, to = flat(x.text(_unwanted)), x.attrs["href"]
            if label.strip("[]()").isdigit() and _NOTE_ANCHOR.search(to):
                out.append(token(label, "citation"))
                continue
            whole = _joined(url, to)
            out.append(token(f"[{label or whole}]({whole})" if whole.startswith(("http://", "https://")) else label, "link"))
        elif x.tag in BLOCK:
            todo += ["\n", *reversed(x.inside), "\n"]
        else:
            todo += reversed(x.inside)
    return lines("".join(out)), fragments


def _joined(url: str, to: str) -> str:
    try:
        return urljoin(url, to)
    except ValueError:  # no address
        return to


def _own_rows(n: Node) -> Iterator[Node]:
    """The rows of a table, not those of tables in its cells."""
    todo = [x for x in reversed(n.inside) if x.__class__ is Node]
    while todo:
        x = todo.pop()
        if x.tag == "tr":
            yield x
        if x.tag != "table":
            todo += [y for y in reversed(x.inside) if y.__class__ is Node]


def _span(said: str, most: int) -> int:
    return min(most, max(1, int(said))) if said.isdecimal() else 1


def grid(n: Node) -> list[list[str]]:
    """A table's cells: a row span repeats its text, a column span is its text and empty cells; rows
    without text go, all rows are of one width."""
    rows: list[list[str]] = []
    held: dict[int, tuple[str, int]] = {}  # column: text and rows to go

    def from_above(at: int, row: dict[int, str]) -> int:
        while at in held:
            text, left = held[at]
            row[at] = text
            held[at] = (text, left - 1)
            if left <= 1:
                del held[at]
            at += 1
        return at

    for tr in _own_rows(n):
        row: dict[int, str] = {}
        at = from_above(0, row) if held else 0
        for cell in tr.inside:
            if cell.__class__ is not Node or cell.tag not in ("td", "th"):
                continue
            if held:
                at = from_above(at, row)
            row[at], attrs = flat(cell.text(_unwanted)), cell.attrs
            if not attrs:
                at += 1
                continue
            wide, high = _span(attrs.get("colspan", "1"), MOST_COLUMNS), _span(attrs.get("rowspan", "1"), MOST_ROWS)
            for i in range(wide):
                if i:
                    row[at] = ""
                if high > 1:
                    held[at] = (row[at], high - 1)
                at += 1
        if held:
            from_above(at, row)
            for column in sorted(held):  # spans beyond a short row
                if column not in row and column > at:
                    from_above(column, row)
        if any(row.values()):
            rows.append([row.get(i, "") for i in range(max(row) + 1)])
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def _whole(said: str | None, default: int) -> int:
    said = (said or "").strip()
    return int(said) if re.fullmatch(r"[+-]?\d{1,9}", said, re.ASCII) else default


def _count_off(n: Node) -> dict[int, int]:
    """The ordinal of each item of an ordered list, by the item's identity: from start, or from their
    number down where the list is reversed; an item's value counts on from there."""
    items = [x for x in n.inside if isinstance(x, Node) and x.tag == "li" and not x.drop]
    back = "reversed" in n.attrs
    at, out = _whole(n.attrs.get("start"), len(items) if back else 1), {}
    for x in items:
        at = _whole(x.attrs.get("value"), at)
        out[id(x)] = at
        at += -1 if back else 1
    return out


#: Blocks that stand for themselves in an item, a quote or a paragraph, after its own text.
_OWN = frozenset(("ul", "ol", "table", "figure", "pre", "img"))


def _held(n: Node) -> list[Node]:
    """What stands for itself below a block, outermost first."""
    out, todo = [], [x for x in reversed(n.inside) if isinstance(x, Node)]
    while todo:
        x = todo.pop()
        if x.drop:
            continue
        if x.tag in _OWN:
            out.append(x)
        elif x.tag != "math":
            todo += [y for y in reversed(x.inside) if isinstance(y, Node)]
    return out


def blocks(root: Node, url: str) -> list[dict]:
    """Typed blocks of a measured content root in order, by one pass with a stack of its own that
    carries what the nodes above tell. Each visible character is in one block: text beside blocks is a
    paragraph, an item's, quote's or paragraph's own text comes before the lists, tables, figures and
    code in it."""
    out: list[dict] = []

    def add(kind: str, bib: str | None, text: str = "", fragments: list[dict] | None = None, **more: object) -> None:
        row = {"type": kind, "level": None, "text": text, "fragments": fragments or [], "caption": "", "bibliography_id": bib, "rows": [], "images": [], "ordinal": None, "depth": None, **more}
        if row["text"] or row["rows"] or row["images"]:
            out.append({**row, "ord": len(out)})

    def images(n: Node) -> list[dict]:
        return [{"src": _joined(url, s), "alt": flat(i.attrs.get("alt", ""))} for i in n.walk() if i.tag == "img" and not i.drop and (s := i.attrs.get("src") or i.attrs.get("data-src"))]

    todo: list[tuple] = [(root, None, "", {}, 0)]  # node or inline nodes, bibliography, caption around it, ordinals, depth of lists
    while todo:
        n, bib, above, ordinals, depth = todo.pop()
        if isinstance(n, list):
            add("paragraph", bib, *rich(n, url, lambda x: False))
            continue
        if n.drop:
            continue
        if bib is None and not _BIB.isdisjoint(n.names()):
            bib = n.attrs.get("id") or n.attrs.get("class") or n.attrs.get("role")
        kind, inside = KINDS.get(n.tag), n.inside
        if kind == "table":
            caption, rows = n.first("caption"), grid(n)
            if rows:
                add(kind, bib, rows=rows, caption=flat(caption.text(_unwanted)) if caption else above)
                continue
        elif kind == "figure":
            caption, inner = n.first("figcaption"), n.first("table")
            said = flat(caption.text(_unwanted)) if caption else ""
            found = [] if inner else images(n)
            if found:
                add(kind, bib, images=found, caption=said or above)
            elif inner and not inner.first("caption"):
                above = said
            if caption and (found or above):  # its text is told
                caption.drop = True
            for i in n.walk() if found else ():
                i.drop = i.drop or i.tag == "img"
        elif kind == "code":
            add(kind, bib, n.text(_unwanted).strip("\n"))
            continue
        elif kind == "equation":
            add(kind, bib, n.attrs.get("alttext") or flat(n.text()))
            continue
        elif kind:
            more = {"level": int(n.tag[1])} if kind == "heading" else {"ordinal": ordinals.get(id(n)), "depth": max(0, depth - 1)} if kind == "list_item" else {}
            add(kind, bib, *rich(inside, url, lambda x: x.tag in _OWN), **more)
            inside = _held(n)
        elif n.tag in ("ul", "ol"):
            depth, ordinals = depth + 1, _count_off(n) if n.tag == "ol" else {}
        below: list[tuple] = []
        run: list[Node | str] = []
        for x in inside:
            if isinstance(x, str) or not (x.block or x.tag in BLOCK or x.tag == "img" or _displayed(x)):
                run.append(x)
                continue
            if run:
                below.append((run, bib, "", {}, depth))
                run = []
            below.append((x, bib, above, ordinals, depth))
        if run:
            below.append((run, bib, "", {}, depth))
        todo += reversed(below)
    return out


def _freed(root: Node) -> None:
    """Nodes that are done with go at once, not when the collector finds them."""
    for n in root.order:
        n.up = None


def page_structure(url: str, html: str) -> dict:
    """Metadata and blocks of a page."""
    root = tree(html)
    meta = metadata(root, url)
    measured(root, meta["title"] or "")
    out = {**meta, "blocks": blocks(content_root(root, meta["title"] or ""), url)}
    _freed(root)
    return out


#: Elements whose texts only say what blocks read, not which blocks there are.
_FRAMING = frozenset("html body main article section div table thead tbody tfoot tr td th p span b i em strong u ul ol li br hr h2 h3 h4 h5 h6".split())
#: Characters of a page and texts that a frame may have, frames that are kept, and the first of the
#: characters that stand for texts.
LONGEST_FRAME, MOST_TEXTS, MOST_FRAMES, _FIRST = 20_000, 2000, 500, 0xE000
_SLOTS = f"[{chr(_FIRST)}-{chr(_FIRST + MOST_TEXTS - 1)}]"
_TAG, _SLOT = re.compile("(<[^<>]*>)"), re.compile(f"({_SLOTS})")
_frames: dict[tuple[str, str], list | bool | None] = {}


def _frame(parts: list[str]) -> list | bool:
    """The blocks of all pages that differ from one, given as texts and tags by turns, in texts alone,
    with the places of texts in order: a number each, or texts and numbers by turns. False where texts
    may tell which blocks there are."""
    n = sum(1 for x in parts[::2] if x and not x.isspace())
    if n > MOST_TEXTS or _SLOT.search("".join(parts[1::2])):
        return False
    at = iter(range(_FIRST, _FIRST + n))
    root = _plain_tree("".join(x if i % 2 or not x or x.isspace() else chr(next(at)) for i, x in enumerate(parts)))
    if root is None or not _FRAMING.issuperset(root.seen):
        return False
    measured(root, "")
    if sum(x.tag == "article" and not x.drop for x in root.order) != 1:  # else texts tell the root
        return False

    def places(text: str) -> int | list:
        if not text:
            return -1
        said = [ord(x) - _FIRST if i % 2 else x for i, x in enumerate(_SLOT.split(text))]
        return said[1] if len(said) == 3 and not said[0] and not said[2] else said

    return [(b, places(b["text"]), [[places(x) for x in row] for row in b["rows"]]) for b in blocks(content_root(root, ""), "")]


def _filled(frame: list, texts: list[str]) -> list[dict]:
    own = [*map(flat, texts), ""]
    cell = lambda at: own[at] if at.__class__ is int else flat("".join(texts[x] if x.__class__ is int else x for x in at))
    said = lambda at: lines(texts[at] if at.__class__ is int else "".join(texts[x] if x.__class__ is int else x for x in at))
    return [{**b, "text": "" if text == -1 else said(text), "rows": [[own[x] if x.__class__ is int else cell(x) for x in row] for row in rows]} for b, text, rows in frame]


def page_blocks(url: str, html: str) -> list[dict]:
    """The blocks of a page. Pages that differ in texts alone are of one frame, which is read once more
    when it is met again; then their texts are put in its places."""
    if len(html) <= LONGEST_FRAME and "&" not in html:
        parts = _TAG.split(html)
        key = "".join(parts[1::2]), "\1".join(["\0" if x and not x.isspace() else x for x in parts[::2]])
        frame = _frames.get(key)
        if frame is None:
            if key in _frames:
                frame = _frames[key] = _frame(parts)
            elif len(_frames) < MOST_FRAMES:
                _frames[key] = None
            else:
                _frames.clear()
        if frame:
            return _filled(frame, [x for x in parts[::2] if x and not x.isspace()])
    root = tree(html)
    title = _said(root, FIELDS["title"]) or ""
    measured(root, title)
    out = blocks(content_root(root, title), url)
    _freed(root)
    return out


def _arrow(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


META = "title string, author string, published string, modified string, scholarly boolean"
BLOCK_FIELDS = "ord int, type string, level int, text string, fragments array<struct<token:string,value:string,kind:string>>, caption string, bibliography_id string, rows array<array<string>>, images array<struct<src:string,alt:string>>, ordinal int, depth int"
_T, _N = pa.string(), pa.int32()
_META = {"title": _T, "author": _T, "published": _T, "modified": _T, "scholarly": pa.bool_()}
_BLOCK = {
    "ord": _N, "type": _T, "level": _N, "text": _T, "fragments": _arrow(token=_T, value=_T, kind=_T), "caption": _T, "bibliography_id": _T, "rows": pa.list_(pa.list_(_T)), "images": _arrow(src=_T, alt=_T), "ordinal": _N, "depth": _N,
}


def _batch(own: dict[str, pa.Array], rows: list[dict], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(own | {k: pa.array([r[k] for r in rows], t) for k, t in fields.items()})


def _texts(b: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    return ((url or "", html or "") for url, html in zip(b["url"].to_pylist(), b["html"].to_pylist(), strict=True))


def read_structure(pages: DataFrame, id_: str = "page_id") -> DataFrame:
    """(id, url, title, author, published, modified, scholarly, blocks) of pages (id, url, html), each
    read once. A null page has no title and no blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch({id_: b[id_], "url": b["url"]}, [page_structure(*x) for x in _texts(b)], _META | {"blocks": _arrow(**_BLOCK)})

    kind, blocks_ = dict(pages.dtypes)[id_], ",".join(f"{x.replace(' ', ':')}" for x in BLOCK_FIELDS.split(", "))
    return pages.select(id_, "url", "html").mapInArrow(run, f"{id_} {kind}, url string, {META}, blocks array<struct<{blocks_}>>")


def page_metadata(pages: DataFrame, id_: str = "page_id") -> DataFrame:
    return read_structure(pages, id_).drop("blocks")


def extract_blocks(pages: DataFrame, id_: str = "page_id") -> DataFrame:
    """A row for each block: id, ord, type, level, text, fragments, caption, bibliography_id, rows, images,
    ordinal and depth of list items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [page_blocks(*x) for x in _texts(b)]
            at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            yield _batch({id_: b[id_].take(at)}, [x for own in found for x in own], _BLOCK)

    return pages.select(id_, "url", "html").mapInArrow(run, f"{id_} {dict(pages.dtypes)[id_]}, {BLOCK_FIELDS}")


def inline_fragments(blocks_: DataFrame, id_: str = "page_id") -> DataFrame:
    """(id, ord, token, value, kind) of each block's tokens."""
    return blocks_.select(id_, "ord", F.inline("fragments"))


def table_cells(blocks_: DataFrame, id_: str = "page_id") -> DataFrame:
    """(id, ord, row, col, text) of each cell of the tables' grids."""
    rows = blocks_.filter("type = 'table'").select(id_, "ord", F.posexplode("rows").alias("row", "cells"))
    return rows.select(id_, "ord", "row", F.posexplode("cells").alias("col", "text"))
