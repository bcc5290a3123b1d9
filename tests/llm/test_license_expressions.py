"""Licences joined in expressions, and long texts of licence words."""

import random
import time

import pytest

from groundwork.llm import license_scan as L
from groundwork.llm import license_texts as X


@pytest.fixture(scope="module")
def index():
    return L.Index({}, 1000, L.Scan())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2,mit"), ("// spdx-license-identifier: Apache-2.0 OR MIT", "apache-2,mit"), ("SPDX-License-Identifier: (MIT OR GPL-3.0-only)", "gpl-3,mit"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 AND (BSD-3-Clause OR MPL-2.0)", "bsd-3,gpl-2,mpl-2"), ("dual licensed under MIT and Apache 2.0", "apache-2,mit"), ("Licensed under MIT or the Apache License, Version 2.0", "apache-2,mit"),
        ("licenced under either of Apache License, Version 2.0 or MIT licence at your option", "apache-2,mit"), ("he was licensed under the council and the mit of old", ""), ("SPDX-License-Identifier: MIT\nuse std and Apache-2.0 tools", "mit"),
    ],
)
def test_expressions(index, text, want):
    assert index.scan(L.terms(text))["labels"] == want


def test_long_texts_of_licence_words(index):
    draw = random.Random(1)
    vocab = sorted({w for _, ws, _ in index.templates for w in ws})
    texts = [" ".join(draw.choice(vocab) for _ in range(50_000)), " ".join(t for _, t, _ in X.templates()) * 8, f"{X.MIT} {X.APACHE_2} " * 300]
    for text in texts:
        ws = L.terms(text)
        begin = time.perf_counter()
        index.scan(ws)
        assert len(ws) >= 50_000 and time.perf_counter() - begin < 4
