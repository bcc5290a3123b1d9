"""Findings and terms against plain versions."""

import random

import pytest

from groundwork.operators import findings as N
from groundwork.operators import terms as T

ISSUES = [
    (0, "a", "稿件没有交代来源", "", "", "blocking"),  # the first pass
    (1, "a", "稿件没有交代来源", "", "", "blocking"),  # requested before
    (1, "b", "稿件没有交代来源", "", "", "deferred"),
    (1, "c", "C2：标题写成了利润，遗漏口径", "", "", "blocking"),  # a fact error wins
    (1, "d", "正文称增长三成，原文未说明", "", "", "blocking"),
    (1, "e", "导语将甲公司表述为龙头，原文为第三名", "", "", "blocking"),
    (1, "f", "正文称稿件没有依据", "", "", "blocking"),  # it asserts, so it is no omission
    (1, "g", "语句不通", "", "", "blocking"),
    (1, "h", "原文该处没有写在表中", "", "", "blocking"),
    (1, "i", "条件没有写在正文", "", "", "deferred"),
    (1, "j", "遗漏来源「样本仅含二零一九年数据」", "样本仅含二零一九年数据。", "别的内容", "blocking"),  # the repair dropped it
    (1, "k", "遗漏来源「样本仅含二零一九年数据」", "样本仅含二零一九年数据。", "样本仅含二零一九年数据", "deferred"),
    (1, "l", "遗漏 2024年1月2日至3月4日 的限定", "于2024年1月2日至3月4日", "于2024年", "blocking"),
    (1, "m", "遗漏来源「太短」", "太短", "无", "deferred"),
    (1, "n", None, None, None, "blocking"),
]


def test_findings_by_wording_and_spans(spark):
    issues = spark.createDataFrame([r[:5] for r in ISSUES], "pass int, scope string, reason string, before string, after string")
    got = {(r["pass"], r["scope"]): r["verdict"] for r in N.classify_findings(issues, issues.filter("pass = 0")).collect()}
    assert got == {(r[0], r[1]): r[5] for r in ISSUES}


def lost(finding, before, after, least):
    n, out = len(finding), []
    for i in range(n):
        for j in range(i + least, n + 1):
            s = finding[i:j]
            if s in before and s not in after and not (i and finding[i - 1 : j] in before) and not (j < n and finding[i : j + 1] in before):
                out.append((i, s))
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab", "abcde", "a漢😀 "])
def test_dropped_spans_against_all_substrings(letters):
    draw = random.Random(len(letters))
    word = lambda n: "".join(draw.choice(letters) for _ in range(draw.randrange(n)))
    for _ in range(400):
        before = word(40)
        after = before[: draw.randrange(1 + len(before))] + word(6)
        finding = word(5) + before[draw.randrange(1 + len(before)) :] + word(12)
        assert sorted(N._lost(finding, before, after, 3)) == lost(finding, before, after, 3)


def test_dropped_spans_of_rows(spark):
    d = spark.createDataFrame([(1, "the sample is small", "the sample is small.", "the sample"), (2, None, "x", "y"), (3, "gone entirely", "gone entirely", None), (3, "gone entirely", "gone entirely", None)], "finding_id int, finding string, before string, after string")
    got = sorted((r["finding_id"], r["start"], r["span"]) for r in N.dropped_spans(d).collect())
    assert got == [(1, 0, "the sample is small"), (3, 0, "gone entirely"), (3, 0, "gone entirely")]


@pytest.mark.parametrize("most", [T.AUTOMATON_CHARS, 0])
def test_terms_on_both_ways(spark, most):
    draw = random.Random(3)
    text = lambda n: "".join(draw.choice("abÄ漢 ") for _ in range(n))
    units = [(i, text(draw.randrange(60))) for i in range(60)] + [(100, None), (101, ""), (102, "AB" * 4000)]
    terms = [(i, text(draw.randrange(1, 8))) for i in range(150)] + [(200, ""), (201, None), (202, "abababababab"), (203, "absent")]
    got = T.term_hits(spark.createDataFrame(units, "unit_id int, text string"), spark.createDataFrame(terms, "term_id int, term string"), most).collect()
    want = sorted((u, t) for u, a in units for t, b in terms if a and b and b.lower() in a.lower())
    assert sorted(map(tuple, got)) == want and want


@pytest.mark.parametrize("most", [T.AUTOMATON_CHARS, 0])
def test_corrections_in_order(spark, most):
    units = spark.createDataFrame([(1, "The Cat sat", "x cat x"), (2, "a dog", "x cat x"), (3, None, "x"), (4, "cat dog", None)], "unit_id int, source string, target string")
    fixes = [("cat", "cat", "lynx"), ("dog", "cat", "hund"), ("sat", "lynx", "LYNX"), ("", "x", "y")]
    assert {r["unit_id"]: r["target"] for r in T.apply_terms(units, fixes, most).collect()} == {1: "x LYNX x", 2: "x hund x", 3: "x", 4: None}


def test_many_terms(spark):
    """50,000 terms over texts of their letters, on both ways alike."""
    terms = spark.range(50_000).selectExpr("id as ord", "concat('t', id, 'e') as source_term", "concat('z', id) as target_term")
    units = spark.createDataFrame([(i, " ".join(f"T{j}e" for j in range(i, 60_000, 701)), f"z{i}x", None) for i in range(40)], "unit_id int, text string, before string, after string")
    ways = [sorted(map(tuple, T.instructions_per_unit(units, terms, m).collect())) for m in (T.AUTOMATON_CHARS, 0)]
    assert ways[0] == ways[1] and len(ways[0]) > 40 * 70
