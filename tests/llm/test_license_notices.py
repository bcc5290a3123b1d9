"""Licence labels on edited notices and on notices that the templates have not word by word."""

from __future__ import annotations

import random

import pytest

from groundwork.llm import license_scan as L


@pytest.fixture(scope="module")
def index():
    """As for a corpus of prose in which the licences' everyday words are common."""
    common = dict.fromkeys("the of to and in a is or for this that with as be by on at an it any all no not from are may can you we".split(), 900)
    return L.Index(common, 1000, L.Scan())


def _words(n: int, r: random.Random) -> list[str]:
    return ["".join(r.choices(("an", "the", "re", "ti", "on", "er", "ou", "st", "de", "la"), k=r.randint(1, 4))) for _ in range(n)]


def _edited(ws: tuple[str, ...], phrases: tuple[tuple[str, ...], ...], r: random.Random) -> list[str]:
    """One word in twenty dropped, one replaced, one added, outside of the mandatory phrases."""
    kept = {i + k for x in phrases for i in range(len(ws)) if ws[i : i + len(x)] == x for k in range(-1, len(x))}
    out = []
    for i, w in enumerate(ws):
        x = r.random() if i not in kept else 1.0
        out += [] if x < 0.05 else _words(1, r) if x < 0.1 else [w, *_words(1, r)] if x < 0.15 else [w]
    return out


def test_edited_notices(index):
    r, hit, total, missed = random.Random(3), 0, 0, []
    for label, ws, phrases in L.wanted_texts():
        for _ in range(3 if len(ws) >= 15 else 1):
            text = [*_words(40, r), *(_edited(ws, phrases, r) if len(ws) >= 15 else ws), *_words(40, r)]
            total += 1
            if label in index.scan(text)["labels"].split(","):
                hit += 1
            else:
                missed.append((label, " ".join(ws[:12])))
    assert total > 400 and hit >= 0.97 * total, missed


def test_long_notices_with_heavier_edits(index):
    r, hit, total = random.Random(4), 0, 0
    for label, ws, phrases in L.wanted_texts():
        if len(ws) >= 30:
            for _ in range(5):
                hit, total = hit + (label in index.scan(_edited(tuple(_edited(ws, phrases, r)), phrases, r))["labels"].split(",")), total + 1
    assert total >= 80 and hit >= 0.9 * total


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("// SPDX-License-Identifier: MIT", "mit"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2"),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution", "epl-2"),
        ("The Software is provided 'as is', without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall ACME Corp be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.", "mit"),
        ("Released under the MIT licence.", "mit"),
        ("See https://creativecommons.org/licenses/by-sa/4.0/ for details", "cc-by-sa"),
        ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "boost-1"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ],
)
def test_notices(index, text, label):
    assert label in index.scan(L.terms(text))["labels"].split(",")


@pytest.mark.parametrize("text", ["the license of the public was general", "MIT is a university and Apache is a helicopter", "we grant permission to use the copy room", "version 2.0 of the software was published under a new name", "CC by the way", "The eclipse was public at 2.0"])
def test_no_notices(index, text):
    assert index.scan(L.terms(text))["labels"] == ""


def test_every_reaching_place_has_an_indexed_word():
    """The words that are not indexed never carry the score by themselves."""
    r = random.Random(5)
    for n in (10, 1000):
        index = L.Index({w: r.randrange(n) for _, ws, _ in L.wanted_texts() for w in ws}, n, L.Scan())
        for t, (_, ws, _) in enumerate(index.templates):
            posted = {i for w in set(ws) for u, i in index.postings.get(w, ()) if u == t}
            assert sum(index.idf[w] for i, w in enumerate(ws) if i not in posted) < index.p.score * index.weight[t]
