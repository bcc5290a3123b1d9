"""Findings of a review: which block, which are deferred, and what a repair dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wordings of findings.
POSITIVE_FACT = "写成了|误写成|误写|误标|误作|说成|写到了|张冠李戴|与原文不符|原文不符|数字不符|并不等于|不等于原文|不得声称|声称未披露|声称实盘|错称实盘|错称实测|并非真实交易|并非实盘|说成真实交易|写成真实交易|混淆了比较组|比较组(?:错误|搞错|对调|写反)|方向(?:写反|相反)|无中生有|虚构|编造|框定为|范围不准确"
DRAFT_GAP = "稿件没有|没有交代|未交代|遗漏|没有在该定位|本次核查未|本次未核实|本次未确认|locators未见|未见各|未见成分|标题用词"
DRAFT_PLACEMENT = "没有写在|未写在|没有明确说明"
SOURCE_PLACEMENT = r"原文[^。\n]{0,16}(?:没有写在|未写在|没有明确说明)"
DRAFT_ASSERTS = r"(?:稿件|标题|正文|导语)(?:将[^。\n]{0,40}?)?(?:(?<!没有|未)称|表述为|框定为|(?<!没有|未)写(?!在))"
SOURCE_UNSUPPORTED = r"原文[^。\n]{0,24}?(?:没有|未)[^。\n]{0,12}?(?:报告|给出|说明|提及|写)|原文为"
DATE_SPAN = r"\d{4}年\d{1,2}月\d{1,2}日(?:至(?:\d{4}年)?\d{1,2}月\d{1,2}日)?"
QUOTED_SPAN = r"(?:原文|来源)[^。\n]{0,48}[“「『]([^”」』]{8,160})[”」』]"


def is_fact_error(text: Column) -> Column:
    """A finding that the draft says what the source does not."""
    return text.rlike(POSITIVE_FACT) | (text.rlike(DRAFT_ASSERTS) & text.rlike(SOURCE_UNSUPPORTED))


def is_omission(text: Column) -> Column:
    """A finding that the draft leaves something out, and no fact error."""
    out = text.rlike(DRAFT_GAP) | (text.rlike(DRAFT_PLACEMENT) & ~text.rlike(SOURCE_PLACEMENT))
    return ~is_fact_error(text) & ~text.rlike(DRAFT_ASSERTS) & out


def source_spans(text: Column) -> Column:
    """Dates, and quoted passages of the source, that a finding names."""
    return F.concat(F.regexp_extract_all(text, F.lit(f"({DATE_SPAN})"), F.lit(1)), F.regexp_extract_all(text, F.lit(QUOTED_SPAN), F.lit(1)))


def dropped_named_span(text: Column, before: Column, after: Column) -> Column:
    """Whether a span that the finding names stands in the draft before and not in the one after."""
    there = F.exists(source_spans(text), lambda s: F.contains(before, s) & ~F.contains(after, s))
    return (F.length(before) > 0) & (F.length(after) > 0) & there


def classify_findings(issues: DataFrame, requested: DataFrame) -> DataFrame:
    """Issues (pass, scope, reason and, if there are, the drafts before and after) as blocking or
    deferred. Deferred is an omission that is first raised after the first pass, was not requested
    before (scope, reason), and is none that the repair made: what it names of the source was in the
    draft before and is gone. A null reason blocks."""
    asked = requested.select("scope", "reason", F.lit(True).alias("_asked")).distinct()
    rows = issues.join(asked, ["scope", "reason"], "left")
    draft = lambda c: F.coalesce(F.col(c), F.lit("")) if c in issues.columns else F.lit("")
    reason = F.coalesce("reason", F.lit(""))
    late = is_omission(reason) & (F.col("pass") > 0) & F.col("_asked").isNull() & ~dropped_named_span(reason, draft("before"), draft("after"))
    return rows.withColumn("verdict", F.when(late, "deferred").otherwise("blocking")).drop("_asked")


class Automaton:
    """All substrings of a text: a state for each class of them that ends at the same places."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for c in text:
            last = self._add(c, last)

    def _add(self, c: str, last: int) -> int:
        new = self._state(self.size[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
            return new
        q = self.next[p][c]
        if self.size[q] != self.size[p] + 1:
            copy = self._state(self.size[p] + 1, dict(self.next[q]))
            self.link[copy] = self.link[q]
            while p >= 0 and self.next[p].get(c) == q:
                self.next[p][c] = copy
                p = self.link[p]
            self.link[q] = copy
            q = copy
        self.link[new] = q
        return new

    def _state(self, size: int, to: dict[str, int]) -> int:
        self.next.append(to)
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def suffixes(self, text: str) -> list[int]:
        """For each place, the length of the longest piece of ``text`` that ends there and is known."""
        out, state, n = [], 0, 0
        for c in text:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.size[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            out.append(n)
        return out


def _lost(finding: str, before: str, after: str, least: int) -> list[tuple[int, str]]:
    had, has = Automaton(before).suffixes(finding), Automaton(after).suffixes(finding)
    ends = [i for i, n in enumerate(had) if n >= least and has[i] < n and (i + 1 == len(had) or had[i + 1] <= n)]
    return [(i + 1 - had[i], finding[i + 1 - had[i] : i + 1]) for i in ends]


def dropped_spans(findings: DataFrame, key: str = "finding_id", least: int = 8) -> DataFrame:
    """(key, start, span): the pieces of a finding (key, finding, before, after) that stand in the draft
    before, can be made longer on neither side, and do not stand in the draft after; of at least
    ``least`` characters. start is counted from 0. Null texts are empty."""
    kind = findings.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *x) for k, a, b, c in zip(f[key], f["finding"], f["before"], f["after"], strict=True) for x in _lost(a, b, c, least)]
            yield pd.DataFrame(rows, columns=[key, "start", "span"])

    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("finding", "before", "after")]
    return findings.select(key, *texts).mapInPandas(run, f"{key} {kind}, start int, span string")
