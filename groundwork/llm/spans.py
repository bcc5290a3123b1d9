"""Spans in texts: how operators hand them over and how queries digest them."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:long,end:long>>"


def in_order(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """By start, then kind as listed, then end; kinds that are not listed come last, by name."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(set(spans), key=lambda s: (s[1], rank.get(s[0], len(kinds)), s[0], s[2]))


class Cover:
    """What spans cover, as stretches in order that do not touch, each found by bisection."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        """Whether a place of the stretch from a to b is covered."""
        i = bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def rest(self, a: int, b: int) -> list[tuple[int, int]]:
        """The parts of a stretch that are not covered."""
        out, i = [], bisect_right(self.ends, a)
        while i < len(self.starts) and self.starts[i] < b:
            out.append((a, self.starts[i]))
            a = self.ends[i]
            i += 1
        return [(x, y) for x, y in [*out, (a, b)] if x < y]


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def digest(spans: Column, base: Column, kinds: tuple[str, ...]) -> list[Column]:
    """n_<kind> and base_sha256 over the ``base`` spans, and all spans."""
    counts = [F.size(of_kinds(base, (k,))).cast("long").alias(f"n_{k}") for k in kinds]
    return [*counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with a mark in place of each stretch that spans cover."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
