"""Personal data by weak supervision.

Candidates are the matches of the fixed patterns and of wider ones (phones in other groups, numbers of
accounts and of social security, written-out addresses, names by title or first name, in English,
German, French and Spanish). Labelers (format, checksum,
gazetteer, context before, context after, shape) vote for, against, or abstain. Over the counts of
all vote patterns of the corpus, expectation-maximisation estimates how reliable each labeler is and
how likely each pattern is personal data (two hidden classes for each kind). Those likelihoods
train the final span classifier, a logistic regression over votes, kind and shape, which decides on
every candidate that the fixed patterns have not already found.

Votes and shapes are a finite code of a candidate, so the counts that reach the driver are bounded
by the number of codes, not by the corpus; every document takes part in them. Candidates are written
once to the shared folder; decisions are looked up by code, so no text is read twice.

Edge cases: a null text is empty; texts without candidates have no spans; spans of the fixed
patterns stay whatever the classifier says, and a further span that touches one of them is left out;
repeated rows are scanned alike; an empty table gives an empty table and trains nothing; further
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.lineage import cut
from groundwork.llm.spans import Cover, in_order
from groundwork.llm.text import whole

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "name")
LABELERS = ("format", "checksum", "gazetteer", "before", "after", "shape")

# fixed values: the patterns of the base kinds, with starts that scan in linear time
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# wider patterns; runs are possessive and begin at a token's start, so that scans are linear
_WIDE_PHONE = re.compile(r"(?<![0-9A-Za-z+.])(?:\+?[0-9]{1,3}[\x20.-])?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_GROUPED_PHONE = re.compile(r"(?<![0-9A-Za-z+.,-])(?<![0-9]\x20)(?:\(?0[0-9]{0,5}\)?|[1-9][0-9]{1,2})(?:[\x20./-][0-9]{2,4}){2,5}+(?![0-9]|[.,][0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])")  # at most 34 signs by the standard
_WIDE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?)[A-Za-z0-9-]++)+")
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Sir Herr Herrn Frau Monsieur Madame Mademoiselle Mme Mlle Señor Señora Señorita señor señora señorita Sr Sra Srta Don Doña Dra M"
_CAP = r"[^\W\d_a-zß-öø-ÿ]['’]?[^\W\d_]++(?:[-'’][^\W\d_]++)*+"
_LINK = r"(?:(?:van|von|de|del|di|da|zu)\x20(?:(?:der|den|la|le|los|las)\x20)?)?+"
_TITLED = re.compile(rf"(?<!\w)(?:(?:{TITLES.replace(' ', '|')})\.?\x20)+{_LINK}{_CAP}(?:\x20{_LINK}{_CAP}){{0,2}}")
_NAMED = re.compile(rf"(?<!\w)({_CAP})(?:\x20[^\W\d_]\.)?\x20{_LINK}{_CAP}")
FIRST = frozenset("""
james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen
daniel nancy matthew lisa anthony betty mark margaret donald sandra steven ashley andrew emily paul donna joshua michelle kenneth carol kevin
amanda brian melissa george deborah edward stephanie henry laura eleanor alice emma olivia jack oliver harry grace sophie
hans peter klaus jürgen wolfgang uwe stefan andreas frank dieter sabine petra monika ursula claudia birgit anja heike katrin lukas jonas felix leon anna lena lea
jean pierre michel philippe alain nicolas françois jacques louis claire nathalie isabelle sylvie catherine martine camille chloé léa manon julien antoine
josé juan manuel carlos luis javier francisco antonio miguel pedro maría carmen ana isabel dolores pilar lucía marta elena sofía pablo diego alejandro fernando maria marie julia
""".split())  # fmt: skip
#: Words that begin names of places, firms and titles, not of people.
_NO_NAME = frozenset("new old great saint san santa los las the der die das ein le la les un une el los una grand united national wall royal ring ringe post street journal bank bahn city".split())
#: Top-level domains of more than two letters; all of two letters are country codes.
_TLDS = frozenset("com net org edu gov mil int info biz app dev shop online site blog cloud tech museum name travel jobs".split())
_COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TN TR UA VA VG XK".split())
_NEAR = {
    "email": "e-?mail|contact|write|reach|address|kontakt|schreib|adresse|écri|courriel|correo|escrib", "ip": "ip|address|host|server|client|login|from", "card": "card|visa|credit|debit|payment|pay|billing|karte|carte|tarjeta",
    "phone": "phone|call|tel|tél|mobile|cell|fax|contact|whatsapp|telefon|ruf|anruf|handy|appel|portable|teléfono|llam|móvil", "ssn": "ssn|social|security|tax",
    "iban": "iban|bank|account|transfer|konto|überweis|compte|virement|banque|cuenta|banco",
    "name": "dear|contact|by|with|name is|met|signed|sincerely|mein name|ansprechpartner|kontakt|appelle|llamo|tenant|ask|from",
}
_NEAR = {k: re.compile(f"(?i)(?<![a-z])(?:{v})") for k, v in _NEAR.items()}
#: What stands right before a name that someone states.
_STATED = re.compile(r"(?i)(?:name is|i am|i'm|dear|mein name ist|ich bin|ich heiße|m'appelle|je suis|me llamo|mi nombre es|soy|signed by|sincerely,|contact|kontakt:|ansprechpartner(?:in)? ist)\s*$")
_AGAINST = re.compile(r"(?i)(?<![a-z])(?:version|release|isbn|issn|order|invoice|section|figure|fig|chapter|serial|sku|part|model|build|ref|licen[sc]e|code|room|total|score|years?|rechnung|kapitel|abbildung|facture|chapitre|factura|capítulo)")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(int(d) * 2 - 9 * (d > "4") for d in even)) % 10 == 0


def _octet(part: str) -> bool:
    return len(y := part.lstrip("0")) <= 3 and int(y or 0) <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and without overlap within a kind."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, m.end() if m else 0))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def wide_spans(text: str, has_digit: bool) -> list[tuple[str, int, int]]:
    """Candidates beyond the fixed patterns."""
    out = []
    if has_digit:
        for kind, p in (("phone", _WIDE_PHONE), ("ssn", _SSN), ("iban", _IBAN)):
            out += [(kind, *m.span()) for m in p.finditer(text)]
        out += [("phone", *m.span()) for m in _GROUPED_PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
        out += [("ip", *m.span()) for m in _IP.finditer(text)]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 12 <= len(_digits(m[0])) <= 19]
    if any(x in text for x in ("at]", "at)", "at}")):
        out += [("email", *m.span()) for m in _WIDE_EMAIL.finditer(text)]
    if _TITLE.search(text):
        out += [("name", *m.span()) for m in _TITLED.finditer(text)]
    if any(w in FIRST for w in map(str.lower, _CAPS.findall(text))):
        ends = {i for _, a, b in out if _ == "name" for i in range(a, b)}
        at = 0
        while m := _NAMED.search(text, at):
            at = m.start(1) + 1
            if m[1].lower() in FIRST and m.start() not in ends:
                out.append(("name", *m.span()))
                at = m.end()
    return out


def _checksum(kind: str, s: str) -> int:
    if kind == "card":
        return 1 if _luhn(_digits(s)) else -1
    if kind == "ip":
        return 1 if all(map(_octet, s.split("."))) else -1
    if kind == "iban":
        c = s.replace(" ", "")
        return 1 if int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    return 0


def _gazetteer(kind: str, s: str) -> int:
    if kind == "email":
        last = re.split(r"[.\])}\x20]", s.lower())[-1]
        return 1 if last in _TLDS or (len(last) == 2 and last.isalpha()) else -1
    if kind == "name":
        ws = s.lower().replace(".", "").split()
        return -1 if _NO_NAME.intersection(ws) else 1 if FIRST.intersection(ws) else 0
    if kind == "iban":
        return 1 if s[:2] in _COUNTRIES else -1
    if kind == "phone":  # a trunk or country prefix
        return 1 if re.match(r"\+|00|\(?0", s) else 0 if _WIDE_PHONE.fullmatch(s) else -1
    return 0


def votes(kind: str, text: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """A vote of each labeler: 1 for, -1 against, 0 abstains."""
    s, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 24]
    digits = len(_digits(s))
    shape = {"email": len(s) <= 80, "ip": 7 <= len(s) <= 15, "card": 13 <= digits <= 16, "phone": 9 <= digits <= 13, "ssn": True, "iban": 15 <= len(s.replace(" ", "")) <= 34, "name": len(s) <= 40}[kind]
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    cut_off = left.isalnum() or right.isalnum() or left in ("-", "/", "#", "$") or right in ("-", "/", "%")
    return (
        1 if base else 0, _checksum(kind, s), _gazetteer(kind, s),
        -1 if _AGAINST.search(before) else 1 if (_STATED if kind == "name" else _NEAR[kind]).search(before) or (kind == "name" and s[: s.find(" ")].rstrip(".") in _TITLE_SET) else 0, 1 if _NEAR[kind].search(after) else 0, -1 if cut_off or not shape else 1,
    )


def code(kind: str, v: tuple[int, ...], s: str) -> int:
    """A candidate's finite code: its kind, its votes and a few bits of its shape."""
    out = KINDS.index(kind)
    for x in v:
        out = out * 3 + x + 1
    return out * 8 + (" " in s) + 2 * ("-" in s) + 4 * (len(s) > 14)


def decode(c: int) -> tuple[int, np.ndarray, np.ndarray]:
    shape, c = np.array([c & 1, c >> 1 & 1, c >> 2 & 1]), c >> 3
    v = []
    for _ in LABELERS:
        v.append(c % 3 - 1)
        c //= 3
    return c, np.array(v[::-1]), shape


def reliabilities(kinds: np.ndarray, v: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The likelihood of personal data for each row (kind, votes) that the corpus has n times.

    Each kind has its own share of true candidates; a labeler that does not abstain votes right with
    a probability of its own in each of the two classes, shared by all kinds; abstaining tells
    nothing. Starts from the majority vote; counts are smoothed, and no labeler is held to be worse
    than chance.
    """
    q = 1 / (1 + np.exp(-v.sum(axis=1).astype(float)))
    k = int(kinds.max()) + 1
    for _ in range(rounds):
        yes, all_ = np.bincount(kinds, q * n, k) + 1, np.bincount(kinds, n, k) + 2
        log = np.log(yes / (all_ - yes))[kinds]
        for j in range(v.shape[1]):
            up, down = v[:, j] == 1, v[:, j] == -1
            right_yes = ((q * n)[up].sum() + 2) / ((q * n)[up | down].sum() + 3)
            right_no = (((1 - q) * n)[down].sum() + 2) / (((1 - q) * n)[up | down].sum() + 3)
            right_yes, right_no = max(right_yes, 0.55), max(right_no, 0.55)
            log = log + up * np.log(right_yes / (1 - right_no)) + down * np.log((1 - right_yes) / right_no)
        q = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return q


def _design(kinds: np.ndarray, v: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return np.hstack([np.eye(len(KINDS))[kinds], v == 1, v == -1, shape]).astype(float)


def classifier(x: np.ndarray, q: np.ndarray, n: np.ndarray, steps: int = 300, ridge: float = 1.0) -> np.ndarray:
    """Weights of the span classifier: logistic regression on soft labels q with counts n, each
    pattern's count damped so that one frequent pattern does not drown the rest."""
    w, weight = np.zeros(x.shape[1]), np.sqrt(n)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (q - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Model:
    """Codes that the span classifier accepts, out of those that the corpus has."""

    accepted: tuple[int, ...]


def trained(counts: list[tuple[int, int]], threshold: float = 0.5) -> Model:
    if not counts:
        return Model(())
    counts = sorted(counts)
    parts = [decode(c) for c, _ in counts]
    n = np.array([m for _, m in counts], float)
    kinds, v, shape = np.array([k for k, _, _ in parts]), np.array([x for _, x, _ in parts]), np.array([s for _, _, s in parts])
    q = reliabilities(kinds, v, n)
    x = _design(kinds, v, shape)
    p = 1 / (1 + np.exp(-x @ classifier(x, q, n)))
    return Model(tuple(c for (c, _), y in zip(counts, p, strict=True) if y >= threshold))


def candidates_of(text: str) -> list[tuple[str, int, int, bool, int]]:
    """(kind, start, end, fixed pattern or not, code) of every candidate of a text."""
    has_digit = _DIGIT.search(text) is not None
    base = base_spans(text) if has_digit or "@" in text else []
    known, cover = set(base), Cover(base)
    wide = [s for s in wide_spans(text, has_digit) if s not in known and not (s[0] == "phone" and cover.meets(s[1], s[2]))]
    out = []
    for kind, a, b in [*base, *wide]:
        fixed = (kind, a, b) in known
        out.append((kind, a, b, fixed, code(kind, votes(kind, text, a, b, fixed), text[a:b])))
    return out


_DIGIT = re.compile(r"[0-9]")
_TITLE = re.compile(rf"(?<!\w)(?:{TITLES.replace(' ', '|')})(?!\w)")
_TITLE_SET = frozenset(TITLES.split())
_CAPS = re.compile(_CAP)
_SPANS = "array<struct<kind:string,start:long,end:long,fixed:boolean>>"
_FOUND = "array<struct<kind:string,start:long,end:long,fixed:boolean,code:long>>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its candidates, a row for each document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("kind", "start", "end", "fixed", "code")
        for f in frames:
            found = [[dict(zip(names, c, strict=True)) for c in candidates_of(x)] for x in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "found": found})

    return docs.select(docs["doc_id"].cast("string").alias("doc_id"), whole("text").alias("text")).mapInPandas(run, f"doc_id string, found {_FOUND}")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and pii_spans, an array of (kind, start, end, fixed) in order, a row for each document;
    fixed tells the spans of the fixed patterns from those that the classifier adds."""
    found = cut(candidates(docs))
    counts = found.select(F.explode("found.code").alias("code")).groupBy("code").count()
    model = trained([(int(c), int(n)) for c, n in counts.collect()])
    accepted = set(model.accepted)

    @F.pandas_udf(_SPANS)
    def chosen(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            base = [(s["kind"], s["start"], s["end"]) for s in row if s["fixed"]]
            spans, cover, last = list(base), Cover(base), -1
            for s in sorted((s for s in row if not s["fixed"] and s["code"] in accepted), key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= last and not cover.meets(s["start"], s["end"]):
                    spans.append((s["kind"], s["start"], s["end"]))
                    last = s["end"]
            known = set(base)
            out.append([{"kind": k, "start": a, "end": b, "fixed": (k, a, b) in known} for k, a, b in in_order(spans, KINDS)])
        return pd.Series(out)

    none = F.expr("array()").cast(_SPANS)
    some = found.filter(F.size("found") > 0).withColumn("pii_spans", chosen("found"))
    rest = found.filter(F.size("found") == 0).withColumn("pii_spans", none)
    return some.unionByName(rest).select(F.col("doc_id").cast("long").alias("doc_id"), "pii_spans")
