import random

import pytest

from groundwork.operators import directives as D

SCOPES = [
    ("翻译第3-5页", False, ("pages", "3", "5")), ("前 4 页", False, ("pages", "1", "4")), ("please translate page 7", False, ("pages", "7", "7")), ("pages 2 through 9", False, ("pages", "2", "9")), ("第5到3页", False, ("invalid-pages", "5", "3")),
    ("翻译参考文献之前", False, ("paper-main", None, None)), ("翻译“方法”到“结论”部分", False, ("sections", "方法", "结论")), ("translate from Methods to Results only", False, ("sections", "Methods", "Results")), ("只翻译第2.1节", False, ("sections", "2.1", "2.1")),
    ("translate section 4", False, ("sections", "4", "4")), ("翻译《附录 A》", False, ("sections", "附录 A", "附录 A")), ("translate the abstract section", False, ("sections", "abstract", "abstract")), ("只要摘要", False, ("sections", "摘要", "摘要")),
    ("全文翻译", False, ("all", None, None)), ("translate everything", False, ("all", None, None)), ("范围改为前3页", True, ("pages", "1", "3")), ("第3页的术语要改", True, None), ("第3页的术语要改", False, ("pages", "3", "3")), ("全文。", True, ("all", None, None)),
    ("https://a.example/page/3?第4页", False, None), ("写得好一点", False, None), ("", False, None), (None, True, None),
]


@pytest.mark.parametrize("text,followup,want", SCOPES)
def test_scope_of_a_message(spark, text, followup, want):
    d = spark.createDataFrame([(text, followup)], "text string, followup boolean")
    got = d.select(D.scope_of(D.plain_request(d["text"]), d["followup"]).alias("s")).first()["s"]
    assert (tuple(got) if got else None) == want


ROWS = [
    (1, 0, "翻译前 3 页\n术语 agent 译为 智能体"),
    (1, 1, "标题改为《新标题》\nmodel -> 模型\n语气平实"),
    (1, 2, "agent 统一译为「代理」"),
    (1, 3, "看看第 9 页的图\n请刷新来源"),  # a follow-up that names no new scope
    (1, 4, "标题改成 A 同时精简正文\n正文翻译成 口语"),  # not alone, and not a term
    (2, 0, None),
    (3, 0, "只翻译摘要"),
    (3, 1, "全文"),
    (3, 2, "封面换成蓝色\n无关的话"),
]


@pytest.mark.parametrize("seed", range(3))
def test_later_messages_reset_nothing(spark, seed):
    rows = list(ROWS)
    random.Random(seed).shuffle(rows)
    m = spark.createDataFrame(rows, "thread int, ord int, text string").repartition(1 + seed)
    got = {r["thread"]: r for r in D.thread_requests(m, "thread", "ord").collect()}
    assert tuple(got[1]["scope"]) == ("pages", "1", "3") and got[1]["title"] == "新标题" and got[1]["refresh"]
    assert [tuple(t) for t in got[1]["terms"]] == [("agent", "代理"), ("model", "模型")]
    assert got[1]["body"] == "翻译前 3 页\n语气平实\n看看第 9 页的图\n标题改成 A 同时精简正文\n正文翻译成 口语"
    assert tuple(got[2]["scope"]) == ("auto", None, None) and got[2]["terms"] == [] and not got[2]["refresh"] and got[2]["body"] == "" and got[2]["title"] is None
    assert tuple(got[3]["scope"]) == ("all", None, None) and got[3]["body"] == "只翻译摘要\n全文\n无关的话"
