"""Spans in long texts: what covers what, and time in proportion."""

import random
import time

from groundwork.llm import pii, secret_scan
from groundwork.llm.spans import Cover


def test_cover_against_places():
    draw = random.Random(2)
    for _ in range(3000):
        spans = [("x", a, a + draw.randrange(1, 7)) for a in (draw.randrange(40) for _ in range(draw.randrange(7)))]
        there = {i for _, a, b in spans for i in range(a, b)}
        cover, a = Cover(spans), draw.randrange(45)
        b = a + draw.randrange(1, 12)
        assert cover.meets(a, b) == any(i in there for i in range(a, b))
        assert [i for x, y in cover.rest(a, b) for i in range(x, y)] == [i for i in range(a, b) if i not in there]
        assert all(x < y for x, y in cover.rest(a, b))


def seconds(f, *args):
    begin = time.perf_counter()
    f(*args)
    return time.perf_counter() - begin


def test_many_spans_in_one_text():
    p = secret_scan.Tagger()
    model = secret_scan.trained(p)
    secrets = "\n".join(f"password = hunter{i}x2Zq9 and api_key: AKq{i}Zp77Lm" for i in range(25_000))
    people = "\n".join(f"mail ann{i}@site{i}.example or call +49 30 {1000000 + i} at 10.0.{i % 250}.{i % 200}" for i in range(17_000))
    secret_scan.find(secrets[:2000], p, model)
    assert len(secret_scan.base_spans(secrets)) == 50_000
    few, many = seconds(secret_scan.find, secrets[: len(secrets) // 5], p, model), seconds(secret_scan.find, secrets, p, model)
    assert many < 9 * few + 1
    few, many = seconds(pii.candidates_of, people[: len(people) // 5]), seconds(pii.candidates_of, people)
    assert len(pii.candidates_of(people)) >= 50_000 and many < 9 * few + 1
