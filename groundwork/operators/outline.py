"""Outline of documents: headings as intervals, and what is told from them.

A heading's section is the interval from its place (open) to the next heading of its level or above, or
the end of the document (close). It is told by windows over the headings, one for each level, so a
document's other blocks do not move for it. Scopes, bibliographies and what is a paper are lookups of
places in these intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Levels of headings, the level of one that says none, headings that an error names.
LEVELS, LEVEL, NAMED = 6, 2, 16
# Patterns of numbers and names of sections, and of addresses of papers.
NUMBER = r"(?i)^\s*(?:第\s*)?([A-Z]|\d+(?:\.\d+)*)(?:\s*[章节.]|\s+|$)"
NUMBER_PART = r"^\s*(?:第\s*)?(?:[a-z]|\d+(?:\.\d+)*)(?:\s*[章节.:：-]|\s+|$)"
NO_LETTERS = r"[^\p{L}\p{N}]+"
REFERENCES = r"(?i)^(?:references?|bibliography|works\s+cited|参考文献|引用文献)$"
REFERENCES_PART = r"(?i)^(?:(?:第\s*)?\d+(?:\.\d+)*(?:\s*[章节.:：、-]\s*|\s+)|[A-Z](?:[.:：]\s*|\s+))"
ABSTRACT = r"(?i)^(?:abstract|摘要)$"
NUMBERED = r"^\s*(?:第\s*)?\d+(?:\.\d+)*(?:\s*[章节.:：、-]|\s+)\s*\S"
PAPER_URL = r"(?i)^https?://(?:www\.)?(?:arxiv|alphaxiv)\.org(?::\d+)?/(?:abs|pdf|html)/\d{4}\.\d{4,5}(?:v\d+)?(?:\.pdf)?(?:[/?#]|$)"


def section_number(text: Column) -> Column:
    """The number or letter that a heading or target begins with, in lower case; else empty."""
    return F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), NUMBER, 1))


def section_name(text: Column) -> Column:
    """The letters and digits of a heading or target after its number, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NUMBER_PART, ""), NO_LETTERS, "")


def is_references(text: Column) -> Column:
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), REFERENCES_PART, "")
    return F.regexp_replace(bare, r"[.:：。\s]+$", "").rlike(REFERENCES)


def _level() -> Column:
    return F.least(F.coalesce(F.col("level"), F.lit(LEVEL)), F.lit(LEVELS)).cast("int")


def outline(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, open, close, level, text, path) of each heading. path has the numbers of the headings
    around it and its own, each counted under the one above; close is null up to the end."""
    h = blocks.filter("type = 'heading'").select(doc, F.col("ord").alias("open"), _level().alias("level"), "text")
    w = W.partitionBy(doc).orderBy("open")
    later = [F.min(F.when(F.col("level") <= n, F.col("open"))).over(w.rowsBetween(1, W.unboundedFollowing)) for n in range(1, LEVELS + 1)]
    h = h.withColumn("close", F.element_at(F.array(*later), F.col("level")))
    for n in range(1, LEVELS + 1):  # the heading above it at each level, then how many of the level since
        h = h.withColumn(f"_above{n}", F.coalesce(F.max(F.when(F.col("level") < n, F.col("open"))).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(-1)))
        h = h.withColumn(f"_n{n}", F.count_if(F.col("level") == n).over(W.partitionBy(doc, f"_above{n}").orderBy("open")))
    path = F.filter(F.array(*[F.when((F.col("level") >= n) & (F.col(f"_n{n}") > 0), F.col(f"_n{n}")) for n in range(1, LEVELS + 1)]), lambda x: x.isNotNull())
    return h.select(doc, "open", "close", "level", "text", path.cast("array<int>").alias("path"))


def _matches(target: str) -> Column:
    number, name = section_number(F.col(target)), section_name(F.col(target))
    own = section_name(F.col("text"))
    named = (own != "") & (F.contains(own, name) | F.contains(name, own))
    return F.when(number != "", section_number(F.col("text")) == number).when(name == "", F.lit(False)).when(is_references(F.col(target)), is_references(F.col("text"))).otherwise(named)


def section_ranges(blocks: DataFrame, requests: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, start, end, open, close, error, available) for each request (doc, start, end), one for each
    document; end may be null for the same as start. A target is told by its number if it begins with
    one, by any name of the references if it is one, or by its name: a heading that holds it or that it
    holds. The first heading that matches counts, for the end from the start's on. error is
    ``start`` or ``end`` for the target that no heading matches, and available has the first 16
    headings; close is null up to the end of the document."""
    r = requests.select(doc, "start", F.coalesce("end", "start").alias("end"))
    h = outline(blocks, doc).join(r, doc)
    first = h.filter(_matches("start")).groupBy(doc).agg(F.min_by(F.struct("open", "close"), "open").alias("_s"))
    same = (section_name(F.col("start")) == section_name(F.col("end"))) & (section_number(F.col("start")) == section_number(F.col("end")))
    last = h.join(first, doc).filter((F.col("open") >= F.col("_s.open")) & _matches("end")).groupBy(doc).agg(F.min_by(F.struct("open", "close"), "open").alias("_e"))
    few = h.groupBy(doc).agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("open", "text"))), 1, NAMED), lambda x: x["text"]), "；").alias("_named"))
    all_ = r.join(first, doc, "left").join(last, doc, "left").join(few, doc, "left")
    end = F.when(same, F.col("_s")).otherwise(F.col("_e"))
    error = F.when(F.col("_s").isNull(), "start").when(end.isNull(), "end")
    fine = error.isNull()
    return all_.select(doc, "start", "end", F.when(fine, F.col("_s.open")).alias("open"), F.when(fine, end["close"]).alias("close"), error.alias("error"), F.when(~fine, F.coalesce("_named", F.lit("无"))).alias("available"))


def slice_sections(blocks: DataFrame, requests: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The blocks of the requested sections, numbered from 0; none where a target is not found."""
    ranges = section_ranges(blocks, requests, doc).filter("error is null").select(doc, F.col("open").alias("_open"), F.col("close").alias("_close"))
    kept = blocks.join(ranges, doc).filter((F.col("ord") >= F.col("_open")) & (F.col("_close").isNull() | (F.col("ord") < F.col("_close")))).drop("_open", "_close")
    return kept.withColumn("ord", F.row_number().over(W.partitionBy(doc).orderBy("ord")) - 1)


def _bibliographies(blocks: DataFrame, doc: str) -> DataFrame:
    """The blocks with _in (of a bibliography), _begins (it opens one) and _end (where that ends; null:
    the document's end). Containers (bibliography_id) come first; a references heading before one
    belongs to it, one without is of all up to its close, in which another does not open anew."""
    w = W.partitionBy(doc).orderBy("ord")
    b = blocks if "bibliography_id" in blocks.columns else blocks.withColumn("bibliography_id", F.lit(None).cast("string"))
    box = F.col("bibliography_id")
    b = b.withColumn("_ref", (F.col("type") == "heading") & is_references(F.col("text")) & box.isNull())
    b = b.withColumn("_next", F.lead(box).over(w)).withColumn("_new", box.isNotNull() & ~box.eqNullSafe(F.lag(box).over(w)))
    # where a run of a container ends: the next block of another container or of none
    changes = F.when(~box.eqNullSafe(F.lag(box).over(w)), F.col("ord"))
    b = b.withColumn("_change", changes).withColumn("_stop", F.min("_change").over(w.rowsBetween(1, W.unboundedFollowing)))
    b = b.withColumn("_stop2", F.lead("_stop").over(w))
    closes = outline(blocks, doc).select(doc, F.col("open").alias("ord"), "close")
    b = b.join(closes, [doc, "ord"], "left")
    open_ = F.col("_ref") & F.col("_next").isNull()
    until = F.max(F.when(open_, F.coalesce(F.col("close"), F.lit(2**31 - 1)))).over(w.rowsBetween(W.unboundedPreceding, 0))
    b = b.withColumn("_in", box.isNotNull() | F.col("_ref") | (F.coalesce(until, F.lit(-1)) > F.col("ord")))
    end = F.when(F.col("_new"), F.col("_stop")).when(F.col("_next").isNotNull(), F.col("_stop2")).otherwise(F.col("close"))
    return b.withColumn("_begins", F.col("_new") | F.col("_ref")).withColumn("_end", end).drop("_ref", "_next", "_new", "_change", "_stop", "_stop2", "close")


def annotate_bibliography(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The blocks with translation_policy: what is of a bibliography is kept as it is, and its
    paragraphs and list items become references."""
    b = _bibliographies(blocks, doc)
    kind = F.when(F.col("_in") & F.col("type").isin("paragraph", "list_item"), "reference").otherwise(F.col("type"))
    policy = F.when(F.col("_in"), "preserve-original")
    kept = F.coalesce(policy, F.col("translation_policy")) if "translation_policy" in blocks.columns else policy
    return b.withColumn("type", kind).withColumn("translation_policy", kept).select(*blocks.columns, *([] if "translation_policy" in blocks.columns else ["translation_policy"]))


def paper_documents(blocks: DataFrame, docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc) of papers among the documents (doc, url, scholarly): by their address, by what their page
    says of itself, or by a bibliography with an abstract and a numbered heading."""
    b = _bibliographies(blocks, doc)
    heading = F.col("type") == "heading"
    told = b.groupBy(doc).agg(F.bool_or("_in").alias("a"), F.bool_or(heading & section_name(F.col("text")).rlike(ABSTRACT)).alias("b"), F.bool_or(heading & F.col("text").rlike(NUMBERED)).alias("c")).filter("a and b and c").select(doc, F.lit(True).alias("_told"))
    return docs.join(told, doc, "left").filter(F.coalesce(F.col("url").rlike(PAPER_URL), F.lit(False)) | F.coalesce("scholarly", F.lit(False)) | F.col("_told").isNotNull()).select(doc).distinct()


def crop_paper_main(blocks: DataFrame, papers: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Blocks of papers (doc) through the end of their first bibliography; without one, all stay and
    boundary is false."""
    b = _bibliographies(blocks.join(papers.select(doc).distinct(), doc, "left_semi"), doc)
    first = b.filter("_begins").groupBy(doc).agg(F.min_by(F.struct("_end"), "ord").alias("_first"))
    kept = b.join(first, doc, "left").filter(F.col("_first").isNull() | F.col("_first._end").isNull() | (F.col("ord") < F.col("_first._end")))
    return kept.withColumn("boundary", F.col("_first").isNotNull()).select(*blocks.columns, "boundary")
