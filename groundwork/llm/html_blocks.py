"""Leaf blocks of an HTML page with what their ancestors and text tell about them."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import NamedTuple

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page, or is a control's.
HIDDEN = frozenset("head script style noscript template iframe object canvas select option datalist textarea button audio video title desc metadata".split())
#: Elements that break a line or a cell; images, inputs and word breaks put no white space into a text.
GAP = frozenset(("br", "td", "th"))
#: Hidden elements that hold phrases: on a page with fewer of their end tags than start tags, the next block ends them.
_PHRASES_ONLY = ("button", "select", "datalist", "canvas", "audio", "video", "object")
#: Ancestors that the tagger knows.
TAGS = frozenset("nav footer header aside article main form section table ul ol dl figure figcaption blockquote pre p li h1 h2 h3 h4 h5 h6 a label address tr details dialog".split())
LANDMARKS = frozenset("article main nav aside footer header form".split())
#: Elements that may stand in a head; any other one, and text, closes a head whose end tag is left out.
#: Elements that hold blocks as one thing, such as a comment with who wrote it.
_HOLDERS = frozenset("div section article li dd td blockquote aside main".split())
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "tr", "tbody", "thead", "tfoot", "caption", "title", "legend"}
_CLOSES = {"li": ("li", frozenset(("ul", "ol", "menu"))), "tr": ("tr", frozenset(("table",))), "dd": ("dd", frozenset(("dl",))), "dt": ("dd", frozenset(("dl",)))}


@dataclass
class Block:
    """linked: characters inside links; tags, marks: known tags and word families of all ancestors;
    near: families of the nearest ancestor that has any; leaf, inner: the nearest known tag and
    landmark; parent: the number of the element that holds the block; holder: of the nearest element
    that holds it, items included; kin: how many elements beside the holder, itself included, have its
    tag and class."""

    text: str
    linked: int
    tags: frozenset[str]
    marks: frozenset[str]
    near: frozenset[str]
    leaf: str
    inner: str
    parent: int
    holder: int = 0
    kin: int = 1


class _Open(NamedTuple):
    """An open element with what its blocks need of all its ancestors, so that depth costs nothing."""

    tag: str
    tags: frozenset[str]
    marks: frozenset[str]
    near: frozenset[str]
    leaf: str
    inner: str
    parent: int
    hides: bool
    holder: int = 0
    kind: tuple = ()


#: Families of words in class, id and role.
FAMILIES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs", "head": "header masthead topbar banner logo branding hero",
    "foot": "footer colophon copyright bottom legal", "side": "sidebar aside rail widget widgets sidenav complementary", "ad": "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion promoted",
    "note": "cookie cookies consent gdpr notice notification alert banner popup modal overlay newsletter subscribe subscription paywall toast dialog", "talk": "comment comments disqus reply replies respond discussion reviews feedback",
    "share": "share sharing social follow related recommended recommendations more trending popular tags tag author byline bio meta", "form": "form search login signup signin register contact",
    "main": "article content post entry story main body text prose page single",
}
#: Words by which a short line, in one of four languages, tells what it heads or is.
SAID = {
    "talk": "readers leserbriefe lectores lecteurs comment comments reply replies response responses discussion opinion opinions reviews said kommentar kommentare antworten meinungen commentaire commentaires réponse réponses répondre avis comentario comentarios respuesta respuestas responder opiniones",
    "share": "also like next related popular trending recommended similar share tweet facebook follow more ähnliche weitere beliebt meistgelesen teilen mehr similaires lire aussi populaires partager suivre relacionados interesar leído compartir seguir más",
    "ad": "advertisement sponsored promoted anzeige werbung gesponsert publicité sponsorisé publicidad anuncio patrocinado",
    "note": "cookie cookies newsletter subscribe subscription consent accept abonnieren einwilligung akzeptieren abonner abonnez inscrivez consentement accepter suscríbete suscribirse boletín consentimiento aceptar",
    "foot": "copyright rights reserved imprint privacy terms impressum datenschutz rechte vorbehalten mentions légales droits réservés confidentialité legal privacidad derechos reservados",
    "form": "search login password username email suche suchen anmelden passwort rechercher connexion buscar contraseña sesión",
    "nav": "home menu contact about startseite menü kontakt accueil contactez inicio menú contacto",
}
_SAYS = {w: f for f, ws in SAID.items() for w in ws.split()}
_WHEN = re.compile(r"(?ai)\b\d{1,2}:\d\d\b|\b\d{4}-\d\d-\d\d\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d+ (?:second|minute|hour|day|week|month|year)s? ago\b|\bvor \d+ \w+|\bil y a \d+|\bhace \d+")


def said(text: str) -> frozenset[str]:
    """Families that the words of a short text tell, and whether it tells a time."""
    if len(text) > 80:
        return frozenset()
    ws = re.findall(r"[^\W\d_]+", text.lower())
    out = {f for w in ws if (f := _SAYS.get(w))} if len(ws) <= 6 and text[-1] not in ".!?" else set()
    return frozenset(out | {"time"}) if _WHEN.search(text) else frozenset(out)


_FAMILY = {w: f for f, ws in FAMILIES.items() for w in ws.split()}
#: Stems by which a longer word, such as commentlist, belongs to a family.
_STEMS = [(x, _FAMILY[x]) for x in ("comment", "advert", "sponsor", "cookie", "sidebar", "footer", "header", "navbar", "breadcrumb", "newsletter", "related", "article", "content", "banner", "social")]
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def families(attrs: list[tuple[str, str | None]]) -> frozenset[str]:
    out = set()
    for k, v in attrs:
        if k in ("class", "id", "role", "aria-label", "itemprop", "data-role") and v:
            out |= {f for w in map(str.lower, _WORDS.findall(v)) if (f := _FAMILY.get(w) or next((y for x, y in _STEMS if w.startswith(x)), None))}
        elif k == "hidden" or (k == "style" and v and "display:none" in v.replace(" ", "").lower()):
            out.add("hidden")
    return frozenset(out)


class _Reader(HTMLParser):
    def __init__(self, unclosed: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.unclosed = unclosed
        none: frozenset[str] = frozenset()
        self.open = [_Open("", none, none, none, "none", "none", 0, False)]
        self.held: Counter[str] = Counter()  # open elements by tag, so that an end tag without its start costs nothing
        self.skip, self.count = 0, 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []
        self.kinds: list[tuple] = []
        self.alike: Counter[tuple] = Counter()

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            e = self.open[-1]
            self.blocks.append(Block(text, self.linked, e.tags, e.marks, e.near, e.leaf, e.inner, e.parent, e.holder))
            self.kinds.append(e.kind)
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body":
            self._close("head", frozenset(("template",)))
        elif tag not in _IN_HEAD and self.open[-1].tag == "head":
            self._cut(len(self.open) - 1)
        if self.unclosed and tag in BLOCK and tag not in ("option", "optgroup"):
            at = next((i for i, e in enumerate(self.open) if e.tag in self.unclosed), None)
            if at is not None:
                self._cut(at)
        if tag in _CLOSES_P:
            self._close("p", frozenset(("article", "section", "div", "td", "li", "blockquote", "main", "aside")))
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag in BLOCK:
            self.end_block()
        elif tag in GAP:
            self.parts.append(" ")
        if tag in VOID:
            return
        self.count += 1
        up, own = self.open[-1], families(attrs) if attrs else frozenset()
        known = tag in TAGS
        holder, kind = up.holder, up.kind
        if tag in _HOLDERS:
            holder, kind = self.count, (up.holder, tag, next((v for k, v in attrs if k == "class"), None))
            self.alike[kind] += 1
        hides = tag in HIDDEN or ("hidden" in own and "hidden" not in up.marks)
        self.open.append(_Open(
            tag, up.tags | {tag} if known and tag not in up.tags else up.tags, up.marks | own if own else up.marks, own or up.near,
            tag if known or tag == "div" else up.leaf, tag if tag in LANDMARKS else up.inner, self.count if tag in BLOCK and tag not in ("p", "li") else up.parent, hides, holder, kind,
        ))
        self.held[tag] += 1
        self.skip += hides

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str, within: frozenset[str]) -> None:
        if not self.held[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._cut(i)
                return
            if self.open[i].tag in within:
                return

    def _cut(self, i: int) -> None:
        self.end_block()
        for e in self.open[i:]:
            self._leave(e)
        del self.open[i:]

    def _leave(self, e: _Open) -> None:
        self.skip -= e.hides
        self.held[e.tag] -= 1

    def handle_endtag(self, tag: str) -> None:
        if tag in GAP:
            self.parts.append(" ")
        if not self.held[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                if any(e.tag in BLOCK for e in self.open[i:]):
                    self._cut(i)
                else:
                    self._drop(i, len(self.open) if tag in HIDDEN else i + 1)
                return

    def _drop(self, i: int, to: int) -> None:
        """Closes phrase elements without ending the block."""
        for e in self.open[i:to]:
            self._leave(e)
        del self.open[i:to]

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._cut(len(self.open) - 1)
        if self.skip <= 0:
            self.parts.append(data)
            if self.held["a"] > 0:
                self.linked += len(data)


def blocks(html: str) -> list[Block]:
    """The page's leaf blocks that are shown as text, in order."""
    low = html.lower()
    r = _Reader(frozenset(t for t in _PHRASES_ONLY if low.count(f"<{t}") > low.count(f"</{t}")))
    r.feed(html)
    r.close()
    r.end_block()
    for b, kind in zip(r.blocks, r.kinds, strict=True):
        b.kin = max(1, r.alike[kind])
    return r.blocks
