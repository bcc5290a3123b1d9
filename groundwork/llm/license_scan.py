"""License scans with a positional index of rare words.

The index holds, for each template (a licence text, a notice, an identifier), postings (template,
position) of its words of highest inverse document frequency over all documents: as many as carry
more than the weight that a match may lack. So no place that reaches the score can lack all of them,
and the words left out lose nothing. A file's licence words are looked up from its rarest on; every
posting tells a start (place - position), and starts that agree up to a band, which edits shift, are
one place. A place whose words carry enough of the template's weight is aligned with it word by word;
if the words in line still do, and the template's mandatory phrases stand inside, it labels the file.
"licence" is read as "license" there. Expressions, identifiers or names joined by or and and, label the
file with each.

Edge cases: a null text is empty; a text without licence words has no label and score 0; places of
the base phrases count whatever the index says; repeated rows are scanned alike; an empty table gives
an empty table; further columns are not read.
"""

from __future__ import annotations

import difflib
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.license_texts import CREATIVE_COMMONS, IDENTIFIERS, NAMES, templates
from groundwork.llm.text import TERM, whole

# fixed values: the base phrases and their labels
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

@dataclass(frozen=True)
class Scan:
    """score: share of a template's weight that a place must have in line. band: words by which edits
    may shift parts of a template, two at least and one in ``band`` of its length."""

    score: float = 0.7
    band: int = 8


_TERMS = re.compile(TERM)


def terms(text: str) -> list[str]:
    """Words of letters and digits, A to Z in lower case (which is what lower() does to bytes)."""
    return _TERMS.findall(text.encode().lower().decode())


SPELLED = {"licence": "license", "licences": "licenses", "licenced": "licensed"}


@lru_cache(maxsize=1)
def wanted_texts() -> tuple[tuple[str, tuple[str, ...], tuple[tuple[str, ...], ...]], ...]:
    """(label, words, words of the mandatory phrases) of each template, each text once."""
    out = {}
    for label, text, phrases in templates():
        ws = tuple(SPELLED.get(w, w) for w in terms(text))
        out.setdefault((label, ws), tuple(tuple(SPELLED.get(w, w) for w in terms(x)) for x in phrases))
    return tuple((label, ws, phrases) for (label, ws), phrases in out.items())


class Index:
    def __init__(self, frequency: dict[str, int], documents: int, p: Scan):
        self.p, self.templates = p, wanted_texts()
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 0.05 for _, ws, _ in self.templates for w in ws}
        self.postings = defaultdict(list)
        self.weight = [sum(self.idf[w] for w in ws) for _, ws, _ in self.templates]
        for t, (_, ws, _) in enumerate(self.templates):
            left = (1 - p.score) * self.weight[t]
            for w in sorted(set(ws), key=lambda w: (-self.idf[w], w)):
                at = [i for i, x in enumerate(ws) if x == w]
                for i in at:
                    self.postings[w].append((t, i))
                left -= len(at) * self.idf[w]
                if left < 0:
                    break
        for other, w in SPELLED.items():
            if w in self.postings:
                self.postings[other] = self.postings[w]
        self.base = [(x.split(), label) for x, label in BASE.items()]
        self.last = {ws[-1] for ws, _ in self.base}
        self.wanted = set(self.postings) | self.last

    def scan(self, ws: list[str]) -> dict:
        base, first, last, found = set(), None, None, 0
        places = defaultdict(list)
        for i, w in enumerate(ws):
            if w not in self.wanted:
                continue
            places[w].append(i)
            if w in self.last:
                for phrase, label in self.base:
                    start = i - len(phrase) + 1
                    if w == phrase[-1] and start >= 0 and ws[start : i + 1] == phrase:
                        base.add(label)
                        found += 1
                        first, last = min(start, first if first is not None else start), max(start, last if last is not None else start)
        best = self._labels(ws, places) if places else {}
        if places:
            best |= dict.fromkeys(expressed(ws), 1.0)
        return {
            "n_words": len(ws), "n_base": found, "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | set(best))), "score": max([1.0 if base else 0.0, *best.values()]),
        }

    def _labels(self, ws: list[str], places: dict[str, list[int]]) -> dict[str, float]:
        """The best score of each label."""
        starts = defaultdict(set)
        for w in sorted(places, key=lambda w: -self.idf.get(SPELLED.get(w, w), 0)):  # the file's rarest words first
            for t, pos in self.postings.get(w, ()):
                starts[t].update(i - pos for i in places[w])
        best: dict[str, float] = {}
        plain, where, aligned = [SPELLED.get(w, w) for w in ws], {}, {}
        for t, some in starts.items():
            label, of, phrases = self.templates[t]
            if best.get(label, 0.0) >= 1.0:
                continue  # no place says more
            band = max(2, len(of) // self.p.band)
            after = None
            for start in sorted(some):
                if after is not None and start <= after:
                    continue  # of the place before
                low, high = max(0, start - band), max(0, start + len(of) + 2 * band)
                after = start + band
                if not all(self._stands(plain, x, low, min(high, len(plain)), where) for x in phrases):
                    continue
                part = tuple(plain[low:high])
                if self._present(part, of) < self.p.score * self.weight[t]:
                    continue
                key = (of, part)
                if key not in aligned:
                    aligned[key] = self._in_line(part, of) / self.weight[t]
                if aligned[key] >= self.p.score:
                    best[label] = max(best.get(label, 0.0), min(1.0, aligned[key]))
        return best

    @staticmethod
    def _stands(ws: list[str], phrase: tuple[str, ...], low: int, high: int, where: dict) -> bool:
        """Whether a phrase stands between two places; all its places in the text are looked for once."""
        if phrase not in where:
            if None not in where:
                where[None] = defaultdict(list)
                for i, w in enumerate(ws):
                    where[None][w].append(i)
            rare = min(range(len(phrase)), key=lambda k: len(where[None].get(phrase[k], ())))
            n = len(phrase)
            where[phrase] = [i - rare for i in where[None].get(phrase[rare], ()) if i >= rare and tuple(ws[i - rare : i - rare + n]) == phrase]
        at = where[phrase]
        i = bisect_left(at, low)
        return i < len(at) and at[i] + len(phrase) <= high

    def _present(self, part: tuple[str, ...], of: tuple[str, ...]) -> float:
        """The weight of the words of ``of`` that ``part`` has, in any order: no alignment has more."""
        have = Counter(part)
        return sum(self.idf[w] * min(n, have[w]) for w, n in Counter(of).items() if w in have) + 1e-9

    def _in_line(self, part: tuple[str, ...], of: tuple[str, ...]) -> float:
        """The weight of the words of ``of`` that ``part`` has in the same order."""
        same = difflib.SequenceMatcher(None, part, of, autojunk=False).get_matching_blocks()
        return sum(self.idf[w] for m in same for w in of[m.b : m.b + m.size])


#: What stands between the names of an expression, before the first, and after the name of an exception.
_JOINS, _BEFORE, _LEADS = frozenset(("or", "and")), frozenset(("either", "of", "both", "the", "terms", "a", "an")), frozenset(("licensed", "released", "distributed", "available", "published", "license", "licensing"))
_SHORT = {"mit": "mit", "apache 2": "apache-2", "apache 2 0": "apache-2", "apache license": "apache-2", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense"}


@lru_cache(maxsize=1)
def _named() -> tuple[dict[tuple[str, ...], str], dict[tuple[str, ...], str]]:
    """Words of identifiers, and of names of any kind, with their labels."""
    ids = {tuple(terms(x)): label for label, xs in IDENTIFIERS.items() for x in xs}
    ids |= {("cc", *short.split("-"), *v.split(".")): f"cc-{short}" for short in CREATIVE_COMMONS for v in ("3.0", "4.0")}
    names = {tuple(SPELLED.get(w, w) for w in terms(x)): label for label, xs in NAMES.items() for x in xs} | {tuple(x.split()): label for x, label in _SHORT.items()}
    return ids, ids | names


def _read(ws: list[str], at: int, names: dict[tuple[str, ...], str], prose: bool) -> tuple[list[str], int]:
    """The labels of names joined by or and and from a place on, and where they end."""
    out: list[str] = []
    while at < len(ws):
        while prose and at < len(ws) and ws[at] in _BEFORE:
            at += 1
        n = next((n for n in range(10, 0, -1) if tuple(ws[at : at + n]) in names), 0)
        if not n:
            break
        out.append(names[tuple(ws[at : at + n])])
        at += n
        if prose and at < len(ws) and ws[at] in ("license", "licenses"):
            at += 1
        if not prose and at < len(ws) and ws[at] == "with":  # an exception, up to what joins
            at = next((i for i in range(at + 1, min(len(ws), at + 8)) if ws[i] in _JOINS), len(ws))
        if at >= len(ws) or ws[at] not in _JOINS:
            break
        at += 1
    return out, at


def expressed(ws: list[str]) -> set[str]:
    """The labels of all names in expressions: after an identifier's mark, and in prose that says under
    what a thing is licensed where it joins several names."""
    ids, names = _named()
    out: set[str] = set()
    for i, w in enumerate(ws):
        if w == "identifier" and i > 1 and ws[i - 2] == "spdx" and ws[i - 1] in ("license", "licence"):
            out.update(_read(ws, i + 1, ids, prose=False)[0])
        elif w == "under" and i and SPELLED.get(ws[i - 1], ws[i - 1]) in _LEADS:
            found = _read([SPELLED.get(x, x) for x in ws[i + 1 : i + 80]], 0, names, prose=True)[0]
            out.update(found if len(found) > 1 else ())
    return out


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """How many documents have each licence word (a fixed list), and how many there are: counted on
    all documents; a number for each word of the list reaches the driver."""
    vocabulary = frozenset(w for _, ws, _ in wanted_texts() for w in ws)

    @F.pandas_udf("array<string>")
    def has(text: pd.Series) -> pd.Series:
        return pd.Series([sorted(vocabulary.intersection(terms(x))) for x in text])

    listed = docs.select(F.explode(F.concat(has(whole("text")), F.array(F.lit("")))).alias("word"))
    n = {r["word"]: r["count"] for r in listed.groupBy("word").count().collect()}
    return n, n.pop("", 0)


def scan(docs: DataFrame, p: Scan | None = None) -> DataFrame:
    """doc_id and the licences of its text, a row for each document. Two scans, no shuffle of texts."""
    index = Index(*frequencies(docs), p or Scan())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame([index.scan(terms(x)) for x in f["text"]], columns=[c.split()[0] for c in RESULT.split(", ")])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", f["doc_id"].to_numpy())
            yield out

    d = docs.select(docs["doc_id"].cast("string").alias("doc_id"), whole("text").alias("text"))
    return d.mapInPandas(run, f"doc_id string, {RESULT}").withColumn("doc_id", F.col("doc_id").cast("long"))
