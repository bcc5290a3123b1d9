"""Secret scans: fixed patterns, and a linear-chain CRF over the tokens around suspicious ones.

Tokens are runs of letters, digits and a few joiners, or single marks. The CRF tags each as outside,
or as begin or inside of a secret without blanks or of a phrase of words, from its shape, its neighbours and the file, and is decoded by
Viterbi over the whole text. Tokens of one shape weigh the same, so the weights are looked up by
shape. A token's weights bound what a secret through it can gain over leaving all outside; where no
run of tokens can gain, outside is the best labelling, and only the other stretches are decoded,
between neighbours that are outside. The labels are those of a decoding of all tokens.

The tagger is trained on the driver from ``lines`` labelled lines that a seeded generator writes
(settings, code, logs and prose, with and without secrets; some secrets are letters only, passphrases,
key blocks, told in prose or split by marks; some harmless words are as long and as hard to say).

Edge cases: a null text is empty; a text without matches has no spans; spans of the patterns stay
whatever the tagger says, and of a tagged span that touches them the part beyond them is left; repeated rows are
scanned alike; an empty table gives an empty table; further columns pass through, and an input column
secret_spans is replaced by ``scan``.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.crf import Crf, train
from groundwork.llm.spans import SPANS, Cover, in_order, redacted
from groundwork.llm.text import whole

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "secret")
# fixed values: the patterns of the base kinds
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")


@dataclass(frozen=True)
class Tagger:
    """lines: labelled lines to train on. reach: tokens before one in which a keyword still counts."""

    lines: int = 3000
    epochs: int = 10
    seed: int = 11
    reach: int = 4


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "=" in text or ":" in text:
        out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


_TOKEN = re.compile(r"\s?(?:[A-Za-z0-9+/_.~-]+|[^\sA-Za-z0-9+/_.~-])")  # with the white space before it
_KEYWORD = re.compile(r"(?ai)pass|pwd|secret|token|key|auth|bearer|cred|signature|salt|cookie|session")
_PHRASE = re.compile(r"(?ai)pass_?phrase")
_SAFE = re.compile(r"(?ai)version|release|page|phone|tel|fax|call|date|time|commit|build|port|id|isbn|doi|order|invoice|price|total|size|license|licence|uuid|ip|host|card|ref")
_ABOUT = re.compile(r"(?ai)[_-](?:count|enabled|timeout|length|limit|reset|file|size|type|url|path|ttl|age|policy)$")  # settings about a secret
_KNOWN = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk[-_]|pk_|rk_|xox[abprs]-|eyJ|AIza|ya29|SG[.]|npm_|pypi-|hf_|dop_v1|shpat_")
_PLAIN = [re.compile(x) for x in (r"\d+", r"\d+([.]\d+)+", r"v\d+([.]\d+)*", r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}", r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", r"[A-Za-z]+[-_.]?\d{1,4}", r"\d+(st|nd|rd|th|px|ms|kb|mb|gb|s|m|h|k|x)")]
_CONSONANTS = re.compile(r"(?ai)[b-df-hj-np-tv-xz]+")
_RAGGED, _ODD = re.compile(r"[A-Z][a-z](?=[A-Z])"), re.compile(r"(?ai)[jqxzvkwy]")
_KINDS_OF_MARK = {"=": "eq", ":": "colon", '"': "quote", "'": "quote", "@": "at", "(": "open", ")": "close", "`": "quote", ",": "stop", ";": "stop"}


def _shape(token: str) -> list[str]:
    tok = token.lstrip()
    gap = [] if tok == token else ["gap:line" if token[0] in "\r\n" else "gap:blank"]
    return gap + _shape_of(tok)


def _shape_of(tok: str) -> list[str]:
    if not (tok[0].isalnum() or tok[0] in "+/_.~-"):
        return [f"mark:{_KINDS_OF_MARK.get(tok) or ('letter' if tok.isalpha() else 'other')}"]
    body = tok.rstrip(".")
    out = [f"len:{min(8, len(body).bit_length() if len(body) < 24 else 6 + (len(body) >= 40))}"]
    kinds = (any("0" <= c <= "9" for c in body), any("a" <= c <= "z" for c in body), any("A" <= c <= "Z" for c in body))
    out.append(f"cls:{kinds[0]:d}{kinds[1]:d}{kinds[2]:d}")
    out += [f"plain:{i}" for i, p in enumerate(_PLAIN) if p.fullmatch(body)]
    if _KNOWN.match(body):
        out.append("known")
    if kinds[0] and len(body) >= 8:
        n = Counter(body)
        entropy = -sum(c / len(body) * math.log2(c / len(body)) for c in n.values())
        out.append(f"entropy:{int(2 * entropy)}")
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:], strict=False))
        out.append(f"turns:{min(4, turns // 2)}")
    elif len(body) >= 8:
        turns = sum(a.isupper() != b.isupper() for a, b in zip(body, body[1:], strict=False) if a.isalpha() and b.isalpha())
        out.append(f"case:{min(5, turns)}")
        hard, ragged = max(map(len, _CONSONANTS.findall(body)), default=0), min(3, len(_RAGGED.findall(body)))
        out += [f"hard:{min(4, hard // 2)}", f"ragged:{ragged}"]
        if len(body) >= 14:
            odd = min(5, 10 * len(_ODD.findall(body)) // len(body))
            out += [f"odd:{odd}", f"mix:{min(4, hard // 2)}:{odd}:{min(ragged, 1)}"]
    if "/" in body:
        out.append(f"slash:{body.startswith('/') or body.count('/') > 2}")
    if _PHRASE.search(tok):
        out.append("phrase")
    if _KEYWORD.search(tok):
        out.append("about" if _ABOUT.search(tok) else "keyword")
    elif _SAFE.fullmatch(tok):
        out.append("safe")
    return out


_BACK = (1, 2, 3)


def _from_own(shape: Sequence[str]) -> list[str]:
    return ["bias", *shape]


def _from_before(shape: Sequence[str], d: int) -> list[str]:
    """Features that a token has from the shape of the token ``d`` places before it."""
    return [f"-{d}:{x}" for x in shape if d == 1 and not x.startswith(("len", "entropy")) or x in ("keyword", "about", "phrase", "safe", "mark:eq", "mark:colon")]


def _from_after(shape: Sequence[str]) -> list[str]:
    return [f"+1:{x}" for x in shape if x.startswith(("mark", "edge", "gap"))]


def _features(tokens: list[str], file: str, reach: int) -> list[list[str]]:
    shapes, edge = [_shape(t) for t in tokens], ["edge"]
    out = []
    for i, own in enumerate(shapes):
        fs = [f"file:{file}", *_from_own(own)]
        for d in _BACK:
            fs += _from_before(shapes[i - d] if i >= d else edge, d)
        fs += _from_after(shapes[i + 1] if i + 1 < len(shapes) else edge)
        near = {x for s in shapes[max(0, i - reach) : i] for x in s}
        fs += [f"near:{x}" for x in ("keyword", "safe") if x in near]
        out.append(fs)
    return out


def _file_kind(text: str) -> str:
    marks = text.count("=") + text.count("{") + text.count(";") + text.count(":")
    return "code" if marks * 60 > len(text) else "some" if marks * 600 > len(text) else "prose"


class _Writer:
    """Labelled lines for training: (text, [(start, end) of secrets])."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def some(self, alphabet: str, low: int, high: int) -> str:
        return "".join(self.r.choices(alphabet, k=self.r.randint(low, high)))

    def word(self) -> str:
        return "".join(self.r.choices(("an", "the", "re", "ti", "on", "er", "ble", "ing", "ou", "st", "de", "la", "chen", "ou", "mi"), k=self.r.randint(1, 4)))

    def compound(self) -> str:
        """A long word as languages have them, with clusters of consonants."""
        parts = self.r.choices(("rechts", "schutz", "ver", "sicher", "ung", "donau", "dampf", "schiff", "fahrt", "keit", "heit", "lich", "sch", "ch", "st", "nd", "wh", "th", "nt", "ble", "tion", "ment", "ness", "ship", "counter", "re", "wachs", "welt", "tz", "er", "ed", "ing", "ly", "zu", "angst", "strength"), k=self.r.randint(3, 7))
        return "".join(parts)

    def prose(self, low: int = 2, high: int = 7) -> str:
        return " ".join(self.written(self.word() if self.r.random() < 0.85 else self.compound()) for _ in range(self.r.randint(low, high)))

    def written(self, word: str) -> str:
        x = self.r.random()
        return word.capitalize() if x < 0.1 else word.upper() if x < 0.13 else word + self.r.choice(("ä", "é", "è", "ß", "ñ", "ó")) + self.r.choice(("", "n", "ti")) if x < 0.25 else word + self.r.choice((",", ".", "!", ";", "!!", "%%%", "&&&", "***", "###", "$$$")) if x < 0.38 else word

    def chosen(self) -> str:
        """What people choose: letters only, split by marks, short."""
        r, a, d = self.r, string.ascii_letters, string.digits
        piece = lambda: r.choice((self.word(), self.some(a + d, 1, 9), self.word().capitalize(), self.some(d, 1, 4)))
        return r.choice((
            lambda: self.some(string.ascii_lowercase, 6, 24), lambda: self.some(a, 8, 32), lambda: self.word() + self.some(d, 1, 4), lambda: self.word() + self.word(),
            lambda: piece() + "".join(r.choice("@@@!#$%^&*?") + piece() for _ in range(r.randint(1, 3))), lambda: piece() + r.choice("@@@!#$%&*") + piece() + r.choice(("!", "#", "?", "")),
        ))()

    def secret(self) -> str:
        a, d, h = string.ascii_letters, string.digits, "0123456789abcdef"
        return self.r.choice((
            lambda: self.some(a + d, 16, 44), lambda: self.some(h, 16, 64), lambda: self.some(a + d + "+/", 24, 60),
            lambda: "ghp_" + self.some(a + d, 36, 36), lambda: "sk-" + self.some(a + d, 20, 48), lambda: "AKIA" + self.some(string.ascii_uppercase + d, 16, 16),
            lambda: "xoxb-" + self.some(d, 10, 12) + "-" + self.some(a + d, 20, 24), lambda: f"eyJ{self.some(a + d, 16, 30)}.eyJ{self.some(a + d, 20, 60)}.{self.some(a + d + '_-', 30, 43)}",
            lambda: self.some(a, 20, 44), lambda: self.some(a, 24, 60), lambda: "AIza" + self.some(a + d + "_-", 35, 35), lambda: self.some(a + d + "_-", 20, 40), lambda: self.some(string.ascii_uppercase + d, 20, 40),
        ))()

    def harmless(self) -> str:
        r, d, h = self.r, string.digits, "0123456789abcdef"
        n = lambda k: "".join(r.choices(d, k=k))
        return r.choice((
            lambda: n(r.randint(1, 6)), lambda: f"{r.randint(0, 30)}.{r.randint(0, 20)}.{r.randint(0, 99)}", lambda: f"20{n(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}",
            lambda: f"{r.randint(1, 254)}.{r.randint(1, 254)}.{r.randint(1, 254)}.{r.randint(1, 254)}", lambda: f"+1 ({n(3)}) 555-{n(4)}", lambda: n(16),
            lambda: f"{self.word()}.{n(2)}@mail{n(1)}.example.com", lambda: f"https://{self.word()}.example.org/{self.word()}/{n(3)}?page={n(1)}",
            lambda: f"{'-'.join(''.join(r.choices(h, k=k)) for k in (8, 4, 4, 4, 12))}", lambda: f"{self.word()}{n(2)}", lambda: f"${n(2)}.{n(2)}", lambda: f"{n(3)}px",
            lambda: f"/usr/{self.word()}/{self.word()}{n(1)}/{self.word()}", lambda: f"{self.word()}_{self.word()}_{n(1)}", lambda: f"version {r.randint(1, 4)}.0", lambda: f"{n(1)},{n(3)}",
            lambda: f"20{n(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T1{n(1)}:{r.randint(10, 59)}:{r.randint(10, 59)}Z", lambda: f"{r.choice(('RFC', 'ISO', 'DIN', 'EN', 'CVE-', 'PR'))}{n(4)}", lambda: "/" + "/".join(self.word() + r.choice(("", "", n(1), "-" + self.word())) for _ in range(r.randint(3, 7))),
            lambda: f"https://{r.choice(('www.', ''))}{self.word()}.{r.choice(('org', 'com', 'net'))}/{'/'.join(r.choice((self.word(), n(r.randint(1, 4)))) for _ in range(r.randint(1, 4)))}/{'-'.join(self.word() for _ in range(r.randint(1, 6)))}",
            lambda: "".join(self.word().capitalize() for _ in range(r.randint(2, 5))),
        ))()

    def line(self) -> tuple[str, list[tuple[int, int]]]:
        r = self.r
        key = r.choice(("password", "secret_key", "api-key", "auth_token", "Authorization", "access_key", "client_secret", "DB_PASS", "private_token", "apiToken", "signing_key"))
        name = r.choice(("version", "release", "port", "user_id", "order", "phone", "build", "commit", "host", "date", "size", "ref", "uuid", "total"))
        hide = r.random() < 0.5
        value = self.secret() if hide else self.harmless()
        label = key if hide or r.random() < 0.1 else name
        head, tail = r.choice((
            (f"{label} = \"", "\""), (f"{label}: ", ""), (f"\"{label}\": \"", "\","), (f"export {label.upper()}=", ""), (f"{label}=", ";"), (f"{self.prose()} ", f" {self.prose()}"),
            (f"{self.prose()} {label} ", f" {self.prose()}."), (f"{label} -> '", "'"), ("Authorization: Bearer " if hide else f"{name}: ", ""), (f"{self.prose()} {label} is ", f", {self.prose()}."),
            (f"curl -H '{label}: ", "' https://example.org/v1"), (f"{self.prose()}. ", ""),
        ))
        if r.random() < 0.3:
            head = f"{self.prose()} {self.harmless()} {self.prose()} {head}"
        if r.random() < 0.3:
            tail = f"{tail} {self.prose()} {self.harmless()} {self.prose()}"
        return head + value + tail, [(len(head), len(head) + len(value))] if hide else []

    def told(self) -> tuple[str, list[tuple[int, int]]]:
        """A line whose words, not the value's looks, tell a secret; or one that looks like it."""
        r, kind = self.r, self.r.choice((0, 0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 6, 6, 6, 7, 7))
        key = r.choice(("password", "passwd", "pwd", "pass", "DB_PASS", "secret", "auth_token", "client_secret", "user_password"))
        name = r.choice(("name", "title", "city", "user", "label", "color", "mode", "author", "note", "path"))
        value, n = self.chosen(), self.prose
        if kind == 0:  # values of settings
            head, tail = r.choice((("", ""), (f"{n()} ", ""), (f"{n()}: ", f" {n()}")))
            eq, end = r.choice(((" = ", ""), ("=", ""), (": ", ""), (":", ""), (' = "', '"'), ("='", "'"), ('": "', '",')))
            head, tail = f"{head}{key}{eq}", f"{end}{tail}"
        elif kind == 1:  # in addresses
            head, tail = f"{r.choice(('', n() + ' '))}{r.choice(('https', 'postgres', 'ftp', 'amqp', 'mysql'))}://{self.word()}:", f"@{self.word()}{r.choice(('', '.example.com'))}{r.choice(('', '/' + self.word(), ' ' + n()))}"
            value = r.choice((self.word() + self.some(string.digits, 1, 3), self.some(string.ascii_letters, 6, 20), self.some(string.ascii_letters + string.digits, 6, 20)))
        elif kind == 2:
            head, tail = f"{r.choice(('', n() + ' '))}{r.choice(('user', 'admin', 'root', self.word()))}:", f"@{r.choice(('host', 'db', self.word()))}{r.choice(('', ' ' + n()))}"
            value = r.choice((self.word() + self.some(string.digits, 1, 3), self.some(string.ascii_letters, 6, 20)))
        elif kind == 3:
            head, tail = f"{r.choice(('', n() + ' '))}Authorization: {r.choice(('Bearer', 'Token', 'Basic'))} ", r.choice(("", f" {n()}", "'"))
            value = self.some(string.ascii_letters, 12, 50)
        elif kind == 4:  # passphrases
            q = r.choice(('"', "'", ""))
            head, tail = f"{r.choice(('', n() + '. '))}{r.choice(('passphrase', 'pass_phrase', 'PASSPHRASE'))}{r.choice((': ', ' = ', '='))}{q}", q
            value = r.choice((" ", "-", " ")).join(self.word() for _ in range(r.randint(3, 6)))
            tail += f"\n{n()}" if r.random() < 0.5 else f", {n()}" if q else ""
        elif kind == 5:  # key blocks
            of = r.choice(("RSA ", "EC ", "OPENSSH ", ""))
            head, tail = f"{r.choice(('', n() + chr(10)))}-----BEGIN {of}PRIVATE KEY-----\n", f"\n-----END {of}PRIVATE KEY-----{r.choice(('', chr(10) + n()))}"
            rows = [*(self.some(string.ascii_letters + string.digits + "+/", 40, 64) for _ in range(r.randint(1, 4))), self.some(string.ascii_letters, 12, 40) + r.choice(("", "=", "=="))]
            ends = [len(head) + sum(map(len, rows[: i + 1])) + i for i in range(len(rows))]  # each line is a secret
            return head + "\n".join(rows) + tail, [(end - len(row), end) for row, end in zip(rows, ends, strict=True)]
        elif kind == 7:  # told in prose, and as arguments of commands
            say = r.choice(("password", "passwd", "secret", "token", "api key", "passcode", "pwd", "secret key"))
            value = r.choice((self.some(string.ascii_lowercase, 16, 30), self.word() + self.some(string.digits, 2, 4), self.word().capitalize() + self.some(string.digits, 2, 4) + r.choice(("!", "?", "#", "")), self.some(string.ascii_letters + string.digits, 8, 30)))
            head = f"{r.choice(('', n() + ' '))}{say} {r.choice(('is ', 'was ', '', 'to ', 'is: '))}"
            tail = r.choice(("", f", {n()}", f" {n()}", ".", f". {n()}"))
            if r.random() < 0.2:
                head, tail = f"{self.word()}-cli {r.choice(('-a', '-p', '--password', '--token'))} ", f" {self.word()}"
        else:  # words, names and capitals that are none
            plain = r.choice((
                lambda: f"{name}{r.choice((': ', ' = ', '='))}{r.choice((self.word(), self.word().capitalize(), n()))}", lambda: f"{n()} {self.word()}{self.word().capitalize()}{self.word().capitalize()}() {n()}",
                lambda: f"{n()} {r.choice(('password', 'token', 'secret', 'key', 'passphrase'))} {n()}", lambda: f"{n()} {r.choice(('password', 'token', 'secret'))} {r.choice(('is', 'was', 'of', 'to', ''))} {n()}.", lambda: f"{n()}: {n()}, {n()}.", lambda: f"{self.word()}@{self.word()}.example.com {n()}", lambda: f"{n()} {self.word()}@{self.word()} {n()}!",
                lambda: f"{n(3, 5)} -- {n()} ({n()}) \"{n()}\"", lambda: n(8, 24), lambda: f"{n()} {self.compound()} {n()} {self.compound().capitalize()}{r.choice(('.', ',', ''))}",
                lambda: f"{r.choice(('token', 'password', 'session', 'key', 'auth', 'secret'))}_{r.choice(('count', 'enabled', 'timeout', 'length', 'limit', 'reset', 'file', 'size', 'type'))}{r.choice((': ', ' = ', '='))}{r.choice(('true', 'false', 'none', self.some(string.digits, 1, 6), self.word()))}",
                lambda: f'{name} = "{n(1, 3)}"', lambda: f"{n()} https://{self.word()}.example.org/{self.word()} {n()}", lambda: f"{self.word()}{r.choice('äöüßéñóíà')}{self.word()} {n()}. {n()}",
            ))()
            return plain, []
        return head + value + tail, [(len(head), len(head) + len(value))]


def labelled(lines: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    w = _Writer(seed)
    return [w.told() if w.r.random() < 0.5 else w.line() for _ in range(lines)]


# labels: the first two begin or go on with a secret without blanks, the others with a phrase
OUT, BEGIN, INSIDE, BEGIN_PHRASE, INSIDE_PHRASE = range(5)
_AFTER = {BEGIN: INSIDE, INSIDE: INSIDE, BEGIN_PHRASE: INSIDE_PHRASE, INSIDE_PHRASE: INSIDE_PHRASE}


def _tags(tokens: list[re.Match], spans: list[tuple[int, int]]) -> list[int]:
    out, last = [], None
    for m in tokens:
        end = m.end()
        s = next((s for s in spans if s[0] < end and end - len(m[0].lstrip()) < s[1]), None)
        blank = s is not None and any(s[0] < t.start() and t.end() <= s[1] and t[0][0].isspace() for t in tokens)
        out.append(OUT if s is None else _AFTER[out[-1]] if s == last else BEGIN_PHRASE if blank else BEGIN)
        last = s
    return out


class Weights:
    """A trained tagger with its weights by shape, for one process. Shapes are numbered as they are
    met, tokens are looked up; 0 is the edge."""

    def __init__(self, crf: Crf, names: dict[str, int], reach: int):
        self.crf, self.names, self.reach = crf, names, reach
        to = crf.step.max(axis=0) - crf.step[0, 0]
        self.enter = np.maximum(to, crf.begin - crf.begin[0])[1:]  # the most that a step to each label of a secret gains
        self.leave = max(0.0, (crf.step[1:, 0] - crf.step[0, 0]).max())
        self.clear()

    def __reduce__(self):
        return _here, (self.crf, self.names, self.reach)

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.shapes: dict[tuple[str, ...], int] = {}
        self.tables: list[list[np.ndarray]] = [[] for _ in range(2 + len(_BACK))]
        self.flags: list[tuple[bool, bool]] = []
        self.made: tuple[int, list[np.ndarray], np.ndarray] = (0, [], np.zeros(0))
        self._add(("edge",))

    def of(self, *features: str) -> np.ndarray:
        return self.crf.emit[[self.names[f] for f in features if f in self.names]].sum(axis=0)

    def _add(self, shape: tuple[str, ...]) -> int:
        parts = [_from_own(shape), *[_from_before(shape, d) for d in _BACK], _from_after(shape)]
        for t, fs in zip(self.tables, parts, strict=True):
            t.append(self.of(*fs))
        self.flags.append(("keyword" in shape, "safe" in shape))
        return self.shapes.setdefault(shape, len(self.shapes))

    def number(self, token: str) -> int:
        shape = tuple(_shape(token))
        n = self.shapes.get(shape)
        n = self._add(shape) if n is None else n
        if len(self.known) < 300_000:  # further ones are shaped each time
            self.known[token] = n
        return n

    def scores(self, tokens: list[str], file: str) -> np.ndarray:
        known = self.known
        at = np.array([n if (n := known.get(t)) is not None else self.number(t) for t in tokens], np.int64)
        if self.made[0] != len(self.flags):
            self.made = (len(self.flags), [np.array(t) for t in self.tables], np.array(self.flags))
        _, (own, *before, after), flags = self.made
        s = own[at] + self.of(f"file:{file}")
        padded = np.concatenate((np.zeros(len(_BACK), np.int64), at, [0]))
        for d, t in zip(_BACK, before, strict=True):
            s += t[padded[len(_BACK) - d : len(padded) - 1 - d]]
        s += after[padded[len(_BACK) + 1 :]]
        for k, name in enumerate(("keyword", "safe")):
            if (has := flags[at, k]).any():
                seen = np.concatenate(([0], np.cumsum(has)))
                i = np.arange(len(at))
                s += (seen[i] > seen[np.maximum(0, i - self.reach)])[:, None] * self.of(f"near:{name}")
        return s

    def tags(self, tokens: list[str], file: str) -> np.ndarray:
        """The best labels of all tokens."""
        out = np.zeros(len(tokens), np.int64)
        if not tokens:
            return out
        s = self.scores(tokens, file)
        gain = (s[:, 1:] - s[:, :1] + self.enter).max(axis=1) + self.leave + 1e-9
        total = np.concatenate(([0.0], np.cumsum(gain)))
        low = np.minimum.accumulate(total)[:-1]
        high = np.maximum.accumulate(total[::-1])[::-1][1:]
        may = high - low >= -1e-6  # some run through the token may gain, by the bound
        edges = np.flatnonzero(np.diff(np.concatenate(([0], may.view(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            out[a:b] = self.best(s[a:b], a == 0, b == len(tokens))
        return out

    def best(self, s: np.ndarray, first: bool, last: bool) -> list[int]:
        """Viterbi over a stretch whose neighbours are outside. Ties go to the smaller label."""
        step, back, labels = self.crf.step.tolist(), [], range(len(self.crf.begin))
        now = ((self.crf.begin if first else self.crf.step[0]) + s[0]).tolist()
        for own in s[1:].tolist():
            ways = [max(labels, key=lambda a: now[a] + step[a][y]) for y in labels]
            back.append(ways)
            now = [now[a] + step[a][y] + own[y] for y, a in enumerate(ways)]
        if not last:
            now = [x + step[y][0] for y, x in enumerate(now)]
        out = [max(labels, key=now.__getitem__)]
        for ways in reversed(back):
            out.append(ways[out[-1]])
        return out[::-1]


_CACHE: dict = {}


def _here(crf: Crf, names: dict[str, int], reach: int) -> Weights:
    """One for each Python worker, so that tasks share the tokens that it knows."""
    key = (crf.emit.tobytes(), crf.step.tobytes(), tuple(names), reach)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Weights(crf, names, reach)
    return _CACHE[key]


@lru_cache(maxsize=2)
def trained(p: Tagger) -> Weights:
    names: dict[str, int] = {}
    data = []
    for text, spans in labelled(p.lines, p.seed):
        tokens = list(_TOKEN.finditer(text))  # spans begin at tokens, not at the white space before them
        seq = [[names.setdefault(f, len(names)) for f in fs] for fs in _features([m[0] for m in tokens], _file_kind(text), p.reach)]
        data.append((seq, _tags(tokens, spans)))
    crf = train(data, len(names), 5, p.epochs)
    for name in ("gap:blank", "gap:line"):
        crf.emit[names[name], INSIDE] = -1e6  # the label's meaning: no blank before it; phrases have blanks
    for label, after in ((OUT, INSIDE), (OUT, INSIDE_PHRASE), (BEGIN, INSIDE_PHRASE), (INSIDE, INSIDE_PHRASE), (BEGIN_PHRASE, INSIDE), (INSIDE_PHRASE, INSIDE)):
        crf.step[label, after] = -1e6  # nothing is inside of what has not begun
    crf.begin[[INSIDE, INSIDE_PHRASE]] = -1e6
    return Weights(crf, names, p.reach)


def tagged_spans(text: str, p: Tagger, model: Weights) -> list[tuple[str, int, int]]:
    """Spans that the tagger finds in a whole text."""
    tags = model.tags(_TOKEN.findall(text), _file_kind(text))
    if not tags.any():
        return []
    out: list[tuple[str, int, int]] = []
    start, end, last = None, 0, OUT
    for t, tag in zip([*_TOKEN.finditer(text), None], [*tags.tolist(), OUT], strict=True):
        goes_on = start is not None and tag == _AFTER.get(last)
        if start is not None and not goes_on:
            out.append(("secret", start, start + len(text[start:end].rstrip(".")) or end))  # a full stop ends the sentence
            start = None
        if tag in (BEGIN, BEGIN_PHRASE):
            start = t.end() - len(t[0].lstrip())
        if start is not None:
            end = t.end()
        last = tag
    return out


def find(text: str, p: Tagger, model: Weights) -> list[tuple[str, int, int]]:
    """All spans of a text, in order: the base ones, and what the tagger finds outside of them."""
    base = base_spans(text)
    cover = Cover(base)
    more = [(k, x, y) for k, a, b in tagged_spans(text, p, model) for x, y in cover.rest(a, b) if text[x:y].strip()]
    return in_order(base + more, KINDS)


def scan(docs: DataFrame, p: Tagger | None = None) -> DataFrame:
    """``docs`` with secret_spans, an array of (kind, start, end). One scan, no shuffle."""
    p = p or Tagger()
    model = trained(p)

    @F.pandas_udf(SPANS)
    def spans(text: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find(x, p, model)] for x in text])

    return docs.withColumn("secret_spans", spans(whole("text")))


def redact(docs: DataFrame, p: Tagger | None = None) -> DataFrame:
    """``docs`` with [kind] in place of each secret, in the same columns."""
    p = p or Tagger()
    model = trained(p)

    @F.pandas_udf("string")
    def safe(text: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else redacted(x, find(x, p, model)) for x in text], dtype=object)

    out = docs.withColumn("text", safe("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
