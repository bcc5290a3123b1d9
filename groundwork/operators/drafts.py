"""Drafts and translations in review: limits, narrowing, findings, triage, retranslation, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundwork.functions.columns import canonical_url, numeric_tokens


def plain_length(text: Column) -> Column:
    """Characters of a Markdown text without links, marks and white space."""
    shown = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.length(F.regexp_replace(shown, r"[*_`~#>\s]", ""))


def item_cap(target: Column) -> Column:
    return F.floor(target * 115 / 100)


def validate_drafts(items: DataFrame, short_items: int = 4, per_item: int = 300, low: int = 3000, high: int = 5000, most: int = 7) -> DataFrame:
    """draft_id, item, rule: what items (draft_id, item, event_id, heading, body, target) break.

    An item may exceed its target by 15 percent; a draft has at most ``most`` items, one for each
    event, a length window, and a heading for each item that doesn't end in a stop."""
    rows = items.withColumn("size", plain_length(F.col("body")))
    each = F.array_compact(F.array(
        F.when(F.col("size") > item_cap(F.col("target")), F.lit("item-too-long")), F.when(F.trim(F.coalesce("heading", F.lit(""))) == "", F.lit("heading-missing")),
        F.when(F.col("heading").rlike(r"[.。!！]\s*$"), F.lit("heading-ends-in-stop")),
    ))
    own = rows.select("draft_id", "item", F.explode(each).alias("rule"))
    by = rows.groupBy("draft_id").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"), F.sum("size").alias("size"))
    floor = F.when(F.col("n") < short_items, F.col("n") * per_item).otherwise(low)
    whole = F.array_compact(F.array(
        F.when(F.col("n") > most, F.lit("too-many-items")), F.when(F.col("events") < F.col("n"), F.lit("event-twice")), F.when(F.col("size") < floor, F.lit("draft-too-short")), F.when(F.col("size") > high, F.lit("draft-too-long")),
    ))
    return own.unionByName(by.select("draft_id", F.lit(None).cast("int").alias("item"), F.explode(whole).alias("rule")))


# What a title, a heading and a body may not have, and lengths.
TITLE_DATED = r"(?:19|20)\d{2}\s*[-/.年]|[\d一二三四五六七八九十〇零]+\s*月|第\s*[\d一二三四五六七八九十百〇零]+\s*期|(?:期数|期号)\s*[:：]?\s*\d+"
AS_TODAY = "今天(?:发布|公布|推出)|今日(?:发布|公布|推出)|今日最新"
HEADING_MARKS, TITLE_MARKS = r"[\r\n<>\[\]`]|https?://", r"[\r\n<>]"
EMBEDDED, INNER = r"(?i)<(?:script|iframe|object|embed)(?![A-Za-z])", r"⟦\d{3}⟧|\[object Object\]|/(?:Users|home|private|var)/"
TITLE_CHARS, HEADING_CHARS, IMPORTANCE = 64, 120, ("lead", "medium", "brief")


def validate_whole_drafts(drafts: DataFrame, items: DataFrame, allowed: DataFrame, short_items: int = 4, per_item: int = 300, low: int = 3000, high: int = 5000, most: int = 7) -> DataFrame:
    """draft_id, item, rule: what drafts (draft_id, title, intro) and their items (draft_id, item,
    card_id, event_id, heading, body, importance, temporal_status) break; item is null for a draft's own
    rules. event_id is null where an item's card is not known. ``allowed`` (draft_id, url) are the
    addresses that a draft may link, compared in canonical form. Each rule stands once for an item, or a
    draft. A draft without items breaks ``items``, and no length is asked of it."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = items.select("draft_id", "item", F.explode(F.array_compact(F.array(
        F.when(F.col("event_id").isNull() | (F.trim(text("body")) == "") | ~text("importance").isin(*IMPORTANCE), F.lit("evidence-or-field-missing")),
        F.when((F.trim(text("heading")) == "") | (F.length(text("heading")) > HEADING_CHARS) | text("heading").rlike(HEADING_MARKS), F.lit("heading-not-plain")),
        F.when((F.col("temporal_status") == "supplement") & text("body").rlike(AS_TODAY), F.lit("supplement-as-today")),
    ))).alias("rule"))
    by = items.groupBy("draft_id").agg(F.count("*").alias("n"), (F.count("event_id") - F.countDistinct("event_id")).alias("twice"), F.sum(plain_length(text("body"))).alias("size"), F.max(text("body").rlike(EMBEDDED)).alias("embeds"), F.max(text("body").rlike(INNER)).alias("inner"), F.max(text("body").rlike(r"!\[[^\]]*\]\(")).alias("images"))
    d = drafts.select("draft_id", "title", "intro").join(by, "draft_id", "left")
    n, size = F.coalesce("n", F.lit(0)), F.coalesce("size", F.lit(0)) + plain_length(text("intro"))
    floor = F.when(n < short_items, n * per_item).otherwise(low)
    flag = lambda c, p: F.coalesce(F.col(c), F.lit(False)) | text("intro").rlike(p)
    whole = d.select("draft_id", F.lit(None).cast("int").alias("item"), F.explode(F.array_compact(F.array(
        F.when((F.trim(text("title")) == "") | (F.length("title") > TITLE_CHARS) | text("title").rlike(TITLE_MARKS), F.lit("title")), F.when(text("title").rlike(TITLE_DATED), F.lit("title-dated")),
        F.when(F.col("intro").isNull() | (n == 0) | (n > most), F.lit("items")), F.when((n > 0) & (size < floor), F.lit("draft-too-short")), F.when((n > 0) & (size > high), F.lit("draft-too-long")),
        F.when(F.col("twice") > 0, F.lit("event-twice")), F.when(F.size(numeric_tokens(text("intro"))) > 0, F.lit("intro-number")), F.when(flag("images", r"!\[[^\]]*\]\("), F.lit("image-in-body")),
        F.when(flag("embeds", EMBEDDED), F.lit("embedded")), F.when(flag("inner", INNER), F.lit("inner-mark")),
    ))).alias("rule"))
    links = F.regexp_extract_all(F.col("text"), F.lit(r"(?<!!)\[[^\]]*\]\((https?://[^()\s]+)\)"), F.lit(1))
    said = drafts.select("draft_id", text("intro").alias("text")).unionByName(items.select("draft_id", text("body").alias("text"))).select("draft_id", F.explode(links).alias("url")).select("draft_id", canonical_url(F.col("url")).alias("url")).distinct()
    may = allowed.select("draft_id", canonical_url(F.col("url")).alias("url")).distinct()
    lost = said.join(may, ["draft_id", "url"], "left_anti").select("draft_id").distinct().select("draft_id", F.lit(None).cast("int").alias("item"), F.lit("link-not-verified").alias("rule"))
    return own.unionByName(whole).unionByName(lost)


def narrow_drafts(items: DataFrame, unsupported: DataFrame, most: int = 2, share: float = 0.15) -> DataFrame:
    """Items (draft_id, item, body) with their unsupported sentences (draft_id, item, sentence) taken
    out, where a draft has at most ``most`` of them, each stands once, ends a sentence and they are at
    most ``share`` of their item; narrowed tells whether that was done."""
    n = unsupported.groupBy("draft_id").agg(F.count("*").alias("_n"))
    lists = unsupported.groupBy("draft_id", "item").agg(F.array_sort(F.collect_list("sentence")).alias("_out"))
    rows = items.join(lists, ["draft_id", "item"], "left").join(n, "draft_id", "left")
    fit = lambda s: (F.length("body") - F.length(F.replace(F.col("body"), s, F.lit(""))) == F.length(s)) & s.rlike(r"[.!?。！？][\"”’)]*\s*$")
    cut = F.aggregate("_out", F.lit(0), lambda a, s: a + plain_length(s))
    ok = F.col("_out").isNotNull() & (F.col("_n") <= most) & F.forall("_out", fit) & (cut <= share * plain_length(F.col("body")))
    body = F.aggregate("_out", F.col("body"), lambda a, s: F.replace(a, s, F.lit("")))
    return rows.withColumn("narrowed", F.coalesce(ok, F.lit(False))).withColumn("body", F.when(F.col("narrowed"), F.trim(body)).otherwise(F.col("body"))).drop("_out", "_n")


def rollup_findings(issues: DataFrame) -> DataFrame:
    """pass, scope, high, warnings: blocking findings and distinct other reasons."""
    high = F.col("severity") == "high"
    return issues.groupBy("pass", "scope").agg(F.count_if(high).alias("high"), F.array_sort(F.collect_set(F.when(~high, F.col("reason")))).alias("warnings"))


def review_triage(units: DataFrame) -> DataFrame:
    """Units (unit_id, source, target, section, repaired, warnings) that need a review, with the reason."""
    sentences = lambda c: F.regexp_count(c, F.lit(r"[.!?。！？](?:\s|$)|[。！？]"))
    reason = (
        F.when(F.col("repaired"), "repaired").when(F.col("warnings") > 0, "warnings").when(sentences("target") < sentences("source"), "sentence-loss")
        .when((F.length("source") > 200) & (F.length("target") < 0.15 * F.length("source")), "too-short").when(F.lower("section").rlike("result|limitation|结果|局限"), "section")
        .when(F.col("source").rlike(r"(?i)(?<![A-Za-z])(?:not|no|never|without|unless|except|only|must)(?![A-Za-z])|\d"), "risk-words")
    )
    return units.withColumn("review_reason", reason).filter("review_reason is not null")


def lint_highlights(units: DataFrame, most: int = 3, low: int = 2, high: int = 64, share: float = 0.45) -> DataFrame:
    """unit_id, rule: bold marks that are unbalanced, too many, too short, too long or cover too much."""
    bold = F.regexp_extract_all("text", F.lit(r"\*\*([^*]+)\*\*"), F.lit(1))
    u = units.withColumn("_b", bold)
    size = F.aggregate("_b", F.lit(0), lambda a, x: a + F.length(x))
    rules = F.array_compact(F.array(
        F.when(F.regexp_count("text", F.lit(r"\*\*")) % 2 == 1, F.lit("unbalanced")), F.when(F.size("_b") > most, F.lit("too-many")),
        F.when(F.exists("_b", lambda x: (F.length(x) < low) | (F.length(x) > high)), F.lit("length")), F.when(size > share * F.length(F.replace(F.col("text"), F.lit("**"), F.lit(""))), F.lit("coverage")),
    ))
    return u.select("unit_id", F.explode(rules).alias("rule"))


def plan_retranslation(units: DataFrame, kinds: Sequence[str], terms: Sequence[str] = ()) -> DataFrame:
    """Units (doc_id, ord, text) to translate again after a change of instructions: none for title and
    cover, units with a changed term and their neighbours for terms, all for anything else."""
    if set(kinds) <= {"title", "cover"}:
        return units.limit(0)
    if set(kinds) <= {"title", "cover", "term"}:
        w = W.partitionBy("doc_id").orderBy("ord")
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.lower("text").contains(t.lower())
        u = units.withColumn("_hit", hit)
        near = F.col("_hit") | F.coalesce(F.lag("_hit").over(w), F.lit(False)) | F.coalesce(F.lead("_hit").over(w), F.lit(False))
        return u.withColumn("_near", near).filter("_near").drop("_hit", "_near")
    return units


def drop_repeated_preamble(blocks: DataFrame, docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Blocks without the text before the first abstract or introduction heading, in documents (doc_id,
    title, authors) whose title or two authors stand there again; figures and tables stay."""
    head = (F.col("type") == "heading") & F.col("text").rlike(r"(?i)^(?:\d+\.?\s+)?(?:abstract|introduction|摘要|引言)")
    first = blocks.filter(head).groupBy(doc).agg(F.min("ord").alias("_first"))
    b = blocks.join(first, doc, "left").join(docs.select(doc, F.col("title").alias("_title"), F.col("authors").alias("_authors")), doc, "left")
    before = F.coalesce(F.col("ord") < F.col("_first"), F.lit(False))
    b = b.withColumn("_before", before)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    lead = b.filter("_before").groupBy(doc).agg(F.lower(F.array_join(texts, "\n")).alias("_lead"), F.first("_title").alias("_title"), F.first("_authors").alias("_authors"))
    named = F.size(F.filter(F.coalesce("_authors", F.array().cast("array<string>")), lambda a: F.col("_lead").contains(F.lower(a))))
    again = lead.filter(F.coalesce(F.col("_lead").contains(F.lower("_title")), F.lit(False)) | (named >= 2)).select(doc, F.lit(True).alias("_again"))
    rows = b.drop("_title", "_authors").join(again, doc, "left")
    return rows.filter(~(F.col("_before") & F.coalesce("_again", F.lit(False)) & ~F.col("type").isin("figure", "table"))).drop("_first", "_before", "_again")


def translation_completeness(source: DataFrame, target: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc_id and, for figures, tables, equations and characters, both sides and whether they agree."""
    def side(d: DataFrame, name: str) -> DataFrame:
        n = lambda t: F.count_if(F.col("type") == t)
        return d.groupBy(doc).agg(n("figure").alias(f"figures_{name}"), n("table").alias(f"tables_{name}"), n("equation").alias(f"equations_{name}"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias(f"chars_{name}"))

    both = side(source, "source").join(side(target, "target"), doc, "full_outer").fillna(0)
    same = lambda c: F.col(f"{c}_source") == F.col(f"{c}_target")
    return both.withColumn("complete", same("figures") & same("tables") & same("equations") & (F.col("chars_target") > 0))


def quota_status(budgets: DataFrame, now: Column, ceilings: dict[str, int]) -> DataFrame:
    """provider, used, capacity, remaining, state of the current period: budgets (provider, period,
    period_start, used, limit_units) whose period has begun last."""
    rank = F.row_number().over(W.partitionBy("provider").orderBy(F.col("period_start").desc(), "period"))
    current = budgets.filter(F.col("period_start") <= now).withColumn("_r", rank).filter("_r = 1")
    ceiling = F.lit(None).cast("long")
    for name, n in ceilings.items():
        ceiling = F.when(F.col("provider") == name, n).otherwise(ceiling)
    capacity = F.least(F.col("limit_units"), ceiling)
    out = current.select("provider", "period", "used", capacity.alias("capacity")).withColumn("remaining", F.greatest(F.col("capacity") - F.col("used"), F.lit(0)))
    return out.withColumn("state", F.when(F.col("remaining") == 0, "exhausted").when(F.col("remaining") * 10 <= F.col("capacity"), "low").otherwise("ok"))


def select_materials(messages: DataFrame, covers: DataFrame, most: int = 12) -> DataFrame:
    """thread_key, url of attachments (files, JSON) and links of a thread, without images and covers;
    too_many where a thread has more than ``most``."""
    files = F.from_json("files", "array<struct<url:string,mimetype:string>>")
    kept = F.transform(F.filter(F.coalesce(files, F.array().cast("array<struct<url:string,mimetype:string>>")), lambda f: ~F.coalesce(f["mimetype"], F.lit("")).startswith("image/")), lambda f: f["url"])
    links = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(https?://[^\s<>\"'|]+)"), F.lit(1))
    rows = messages.select("thread_key", F.explode(F.concat(kept, links)).alias("url")).distinct().join(covers.select("thread_key", "url"), ["thread_key", "url"], "left_anti")
    return rows.withColumn("too_many", F.count("*").over(W.partitionBy("thread_key")) > most)


def freeze_context(starts: DataFrame, issue: str = "issue_date", at: str = "started_at") -> DataFrame:
    """issue, cutoff_at, window_start, supplement_start: fixed by the first start of an issue."""
    first = starts.groupBy(issue).agg(F.min(at).alias("cutoff_at"))
    return first.withColumn("window_start", F.col("cutoff_at") - F.expr("interval 24 hours")).withColumn("supplement_start", F.col("cutoff_at") - F.expr("interval 7 days"))


def digest_stats(candidates: DataFrame, cards: DataFrame, items: DataFrame, run: str = "run_id") -> DataFrame:
    """run_id, candidates, read, ineligible, verified, selected, degraded."""
    c = candidates.groupBy(run).agg(F.count("*").alias("candidates"), F.count_if("deep_read").alias("read"), F.count_if(F.col("deep_read") & ~F.col("eligible")).alias("ineligible"))
    v = cards.filter("accepted").groupBy(run).agg(F.count("*").alias("verified"))
    s = items.groupBy(run).agg(F.countDistinct("card_id").alias("selected"))
    out = c.join(v, run, "left").join(s, run, "left").fillna(0, ["verified", "selected"])
    return out.withColumn("degraded", F.col("selected") < 4)
