"""What a thread asks for: scope, title, terms and fresh sources, folded over its messages.

Each message is read where it stands, by patterns; a thread keeps the last value of each thing, and of
each term, that any message gave. So a later message that says nothing of a thing leaves it, and the
fold is one aggregate for each thread, whatever the order in which rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of what a message asks for.
URL = r"(?i)https?://[^\s<>()，。；：！？】【、）》〉]+"
CHANGED = r"^(?:请\s*)?(?:(?:把|将)?(?:翻译)?范围\s*)?(?:改为|改成|换成|改译|调整为)\s*"
ONLY = r"^(?:只要|仅要)\s*"
NEW_SCOPE = r"(?i)^(?:请|帮我|麻烦)?\s*(?:只|仅|全文|完整)?\s*(?:翻译|直译)|^(?:please\s+)?translate(?![A-Za-z0-9_])|^(?:全文|全部|整篇|整个文档)[。.!！]?$|^(?:第?\s*\d+\s*(?:[-–—~～到至]\s*\d+\s*)?页|前\s*\d+\s*页)[。.!！]?$"
PAGES = (r"(?i)第?\s*(\d{1,4})\s*(?:[-–—~～]|到|至)\s*第?\s*(\d{1,4})\s*页", r"(?i)(?<![A-Za-z0-9_])pages?\s*(\d{1,4})\s*(?:[-–—~]|to|through)\s*(\d{1,4})(?![A-Za-z0-9_])")
FIRST_PAGES = (r"(?i)(?:前|头)\s*(\d{1,4})\s*页", r"(?i)(?<![A-Za-z0-9_])first\s+(\d{1,4})\s+pages?(?![A-Za-z0-9_])")
ONE_PAGE = (r"(?i)第\s*(\d{1,4})\s*页", r"(?i)(?<![A-Za-z0-9_])page\s*(\d{1,4})(?![A-Za-z0-9_])")
MAIN = r"""(?i)(?:翻译|直译)\s*(?:范围\s*[:：]?\s*)?[“"'《]?(?:参考文献|引用文献|references?|bibliography)[”"'》]?\s*(?:之前|以前|前)(?:[。.!！]|\s|$)"""
SECTIONS = (r"""(?i)(?:只\s*)?翻译\s*(?:从\s*)?[“"'《]?([^“”"'《》]{1,80}?)[”"'》]?\s*(?:到|至)\s*[“"'《]?([^“”"'《》]{1,80}?)[”"'》]?(?:\s*(?:章节|部分))?(?:\s|$)""", r"(?i)(?<![A-Za-z0-9_])translate\s+from\s+(.{1,80}?)\s+(?:to|through)\s+(.{1,80}?)(?:\s+only)?$")
NAMES = "abstract|introduction|conclusion|limitations?|acknowledg(?:e)?ments?|references?|appendix"
SECTION = (
    r"(?i)(?:只\s*)?翻译\s*第?\s*(\d+(?:\.\d+)*)\s*(?:章|节|部分)", r"(?i)(?<![A-Za-z0-9_])translate\s+section\s+(\d+(?:\.\d+)*)(?![A-Za-z0-9_])", r"""(?i)(?:只\s*)?翻译\s*[“"'《]([^“”"'《》]{1,80})[”"'》]\s*(?:章节|部分)?""",
    rf"(?i)(?:只\s*)?翻译\s*((?:摘要|引言|介绍|结论|局限性|致谢|参考文献|附录|{NAMES})(?:\s+[A-Za-z0-9 .:_-]+)?)(?:\s*(?:章节|部分))?", rf"""(?i)(?<![A-Za-z0-9_])translate\s+(?:the\s+)?(?:section\s+)?["']?((?:{NAMES})(?:\s+[A-Za-z0-9 .:_-]+?)?)["']?(?:\s+section)?(?:\s+only)?$""",
)
ALL = r"(?i)^(?:全文|全部|整篇|整个文档)[。.!！]?$|(?:翻译|直译)\s*(?:全文|全部|整篇|整个文档)|(?:全文|全部|整篇|整个文档)\s*(?:翻译|直译)|(?<![A-Za-z0-9_])translate\s+(?:the\s+)?(?:whole|entire|full)\s+(?:text|article|document|paper)|(?<![A-Za-z0-9_])translate\s+(?:everything|all)(?![A-Za-z0-9_])"
REFRESH = r"(?i)^(?:请)?(?:重新获取|重新下载|刷新)(?:一下)?(?:原文|来源|材料)[。！!]?$"
TITLE = r"(?i)^(?:请)?(?:把)?(?:文章)?标题\s*(?:改成|改为|设为|换成|[:：])\s*(.+)$"
COVER = r"(?i)^(?:请)?(?:把)?(?:文章)?封面(?:图片|图)?\s*(?:改成|换成|改为|换为|改用|换用|使用|设为|用|[:：])\s*(.+)$"
TERM = r"(?i)^(?:请)?(?:术语[:：]?\s*)?(.{1,80}?)\s*(?:统一)?(?:译为|翻译为|翻译成|改译为|统一为|->|→)\s*(.{1,80})$"
NO_TERM = "^(?:文章|正文|全文|内容|整体|这段|这篇|这个|上文|原文)"
MORE = r"[，,；;。\s](?:并|同时|然后|再|且)|并(?:将|把|精简|修改|改写|翻译|压缩)|同时|并且|顺便|然后|(?:精简|改写|重译|扩写|删减|增加|缩短|润色)(?:正文|全文|内容)"
QUOTES = ("^[“”\"'「」`《》]+", "[“”\"'「」`。《》]+$")
TARGET = (r"(?i)^第\s*", r"(?i)\s*(?:章节|部分)$", r"(?i)\s+(?:section|part)(?:\s+only)?$", r"(?i)\s+only$")
LAST_PAGE = 9999


def _bare(value: Column, patterns: tuple[str, ...]) -> Column:
    for p in patterns:
        value = F.regexp_replace(value, p, "")
    return F.trim(value)


def _scope(kind: str, start: Column, end: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))


def plain_request(text: Column) -> Column:
    """A message without addresses, on one line, with other ways to ask for a scope as one."""
    t = F.translate(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), URL, " "), r"\s+", " ")), "‘’", '""')
    rest = F.regexp_replace(t, CHANGED, "")
    t = F.when(~t.rlike(CHANGED), t).when(rest.rlike("^(?:只|仅)?(?:翻译|直译)"), rest).otherwise(F.concat(F.lit("翻译 "), rest))
    return F.regexp_replace(t, ONLY, "翻译 ")


def scope_of(t: Column, followup: Column) -> Column:
    """The scope (kind, start, end) that a message, as ``plain_request`` gives it, names; null for none.
    kind is pages, paper-main, sections or all. A follow-up has to ask for a scope in so many words.
    Pages that are no range, such as 5 to 3 or page 0, are of kind invalid-pages."""
    group = lambda p, i: F.regexp_extract(t, p, i)
    none = F.lit(None).cast("string")
    page = lambda p, a, b: F.when(t.rlike(p), F.when((a.cast("int") >= 1) & (b.cast("int") >= a.cast("int")), _scope("pages", a.cast("int").cast("string"), b.cast("int").cast("string"))).otherwise(_scope("invalid-pages", a, b)))
    named = lambda p, a, b: F.when(t.rlike(p), _scope("sections", _bare(group(p, a), TARGET), _bare(group(p, b), TARGET)))
    found = F.coalesce(
        *[page(p, group(p, 1), group(p, 2)) for p in PAGES], *[page(p, F.lit("1"), group(p, 1)) for p in FIRST_PAGES], *[page(p, group(p, 1), group(p, 1)) for p in ONE_PAGE],
        F.when(t.rlike(MAIN), _scope("paper-main", none, none)), *[named(p, 1, 2) for p in SECTIONS], *[named(p, 1, 1) for p in SECTION], F.when(t.rlike(ALL), _scope("all", none, none)),
    )
    return F.when(~followup | t.rlike(NEW_SCOPE), found)


def _lines(messages: DataFrame, thread: str, order: str, text: str) -> DataFrame:
    """(thread, order, n, line, said): trimmed lines with what kind each is."""
    line = F.trim(F.col("line"))
    rows = messages.select(thread, F.col(order).alias("o"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line")).withColumn("line", line).filter("line <> ''")
    alone = lambda p, i: F.col("line").rlike(p) & ~F.regexp_extract("line", p, i).rlike(MORE)
    term = alone(TERM, 2) & (F.col("line").contains("术语") | ~F.regexp_extract("line", TERM, 1).rlike(NO_TERM))
    kind = F.when(F.col("line").rlike(REFRESH), "refresh").when(alone(TITLE, 1), "title").when(alone(COVER, 1), "cover").when(term, "term").otherwise("content")
    return rows.withColumn("said", kind)


def thread_requests(messages: DataFrame, thread: str, order: str, text: str = "text") -> DataFrame:
    """(thread, scope, title, terms, refresh, body) of messages in order: the last scope, title and, of
    each term, translation that was given; whether fresh sources were asked for; and the lines that say
    anything else, in order. terms is an array of (source, target, at), in the order in which they were
    first given. A thread without a scope has kind auto."""
    first = messages.groupBy(thread).agg(F.min(order).alias("_first"))
    plain = messages.join(first, thread).select(thread, order, "_first", plain_request(F.col(text)).alias("_plain"))
    m = plain.withColumn("_scope", scope_of(F.col("_plain"), F.col(order) > F.col("_first")))
    scope = m.groupBy(thread).agg(F.max_by("_scope", F.when(F.col("_scope").isNotNull(), F.col(order))).alias("scope"))
    lines = _lines(messages, thread, order, text)
    at = F.struct("o", "n")
    terms = lines.filter("said = 'term'").select(thread, "o", "n", _bare(F.regexp_extract("line", TERM, 1), QUOTES).alias("source"), _bare(F.regexp_extract("line", TERM, 2), QUOTES).alias("target"))
    terms = terms.groupBy(thread, "source").agg(F.max_by("target", at).alias("target"), F.min(at).alias("at"))
    terms = terms.groupBy(thread).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "source", "target"))), lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"))).alias("terms"))
    told = lines.groupBy(thread).agg(
        F.max_by(_bare(F.regexp_extract("line", TITLE, 1), QUOTES), F.when(F.col("said") == "title", at)).alias("title"), F.bool_or(F.col("said") == "refresh").alias("refresh"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("said") == "content", F.struct("o", "n", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    auto = _scope("auto", F.lit(None).cast("string"), F.lit(None).cast("string"))
    out = scope.join(told, thread, "left").join(terms, thread, "left")
    return out.select(thread, F.coalesce("scope", auto).alias("scope"), "title", F.coalesce("terms", F.array().cast("array<struct<source:string,target:string>>")).alias("terms"), F.coalesce("refresh", F.lit(False)).alias("refresh"), F.coalesce("body", F.lit("")).alias("body"))
