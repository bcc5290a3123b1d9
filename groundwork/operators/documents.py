"""Documents: duplicates, licences, credentials, locators, excerpts, links, manifests."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundwork.functions.columns import SECRET_TOKEN, SPACE, collapsed, numeric_tokens, redacted


def content_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, sha256, first_id (earliest with that content), n. Only ids and hashes are shuffled."""
    hashed = docs.select(F.col(id_), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"))
    by = hashed.groupBy("sha256").agg(F.min(id_).alias("first_id"), F.count("*").alias("n"))
    return hashed.join(by, "sha256").select(id_, "sha256", "first_id", "n")


# fixed values: licences under which figures may be shown
PERMITTED = r"^https?://creativecommons\.org/(?:licenses/by/(?:1\.0|2\.0|2\.5|3\.0|4\.0)|publicdomain/zero/1\.0)/?$"


def gate_licenses(docs: DataFrame, url: str = "license_url", verified: str = "license_verified") -> DataFrame:
    return docs.withColumn("permitted", F.coalesce(F.col(url).rlike(PERMITTED) & F.col(verified), F.lit(False)))


def gate_text_length(docs: DataFrame, text: str = "text", low: int = 120, high: int = 160_000) -> DataFrame:
    n = F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))
    return docs.withColumn("reason", F.when(n < low, "too-short").when(n > high, "too-long")).withColumn("eligible", F.col("reason").isNull())


# Sections that tell a paper's body, and the sizes that each kind of document needs.
PAPER_SECTIONS = r"(?i)(?<![A-Za-z0-9_])(?:Introduction|Method(?:s|ology)?|Results|Experiments?|Conclusion|References|Background)(?![A-Za-z0-9_])|引言|方法|实验|结果|参考文献"
PAPER_HEADINGS = r"(?i)Introduction|Method(?:s|ology)?|Results|Experiments?|Conclusion|References|Background|引言|方法|实验|结果|参考文献"
LEAST_CHARS = {"pdf": 1200, "paper": 1500, "release": 80, "text": 120, "page": 120}
MOST_CHARS, MOST_PAGES, LEAST_SECTIONS = 160_000, 100, 2


def gate_documents(docs: DataFrame) -> DataFrame:
    """Documents (kind, text, headings, pages, expected_pages, encrypted) with the reason why one may not
    be read in depth, and eligible. kind is pdf, paper (a page of one), release, text or page. A PDF has
    1 to 100 pages, all of which were read, is not encrypted and has two words of a paper's sections in
    its text; a paper's page has two in its distinct headings; a text has no null characters and a size
    in its kind's bounds. A document of no known kind is not eligible."""
    text = F.trim(F.coalesce("text", F.lit("")))
    n, pdf, paper = F.length(text), F.col("kind") == "pdf", F.col("kind") == "paper"
    least = F.element_at(F.create_map(*[F.lit(x) for kv in LEAST_CHARS.items() for x in kv]), F.col("kind"))
    pages = F.coalesce("expected_pages", F.lit(0))
    heads = F.array_join(F.array_distinct(F.coalesce("headings", F.array().cast("array<string>"))), " ")
    reason = (
        F.when(F.coalesce("kind", F.lit("")).isin(*LEAST_CHARS) == F.lit(False), "unknown-kind").when(pdf & ~pages.between(1, MOST_PAGES), "page-count").when(pdf & F.coalesce("encrypted", F.lit(False)), "encrypted")
        .when(n < least, "too-short").when(n > MOST_CHARS, "too-long").when(F.contains(text, F.lit(chr(0))), "not-text").when(pdf & (F.coalesce("pages", F.lit(0)) != pages), "pages-lost")
        .when(pdf & (F.regexp_count(text, F.lit(PAPER_SECTIONS)) < LEAST_SECTIONS), "no-body").when(paper & (F.regexp_count(heads, F.lit(PAPER_HEADINGS)) < LEAST_SECTIONS), "abstract-only")
    )
    return docs.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())


def scan_credentials(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, kind, hit of every credential in a text."""
    pairs = F.regexp_extract_all(text, F.lit(r"(?i)((?:access_token|appsecret|secret|token|key|password)=[^&\s]+)"), F.lit(1))
    marks = F.regexp_extract_all(text, F.lit(f"({SECRET_TOKEN})"), F.lit(1))
    kind = lambda name, c: F.transform(c, lambda x: F.struct(F.lit(name).alias("kind"), x.alias("hit")))
    return docs.select(id_, F.explode(F.concat(kind("pair", pairs), kind("token", marks))).alias("h")).select(id_, "h.kind", "h.hit")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, redacted(F.col(text)))


def build_locators(docs: DataFrame, separator: str = r"\n[ \t]*\n", id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n, locator_id, text: the parts of a text that are not blank, numbered L1, L2, ..."""
    parts = F.filter(F.transform(F.split(text, separator), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return docs.select(id_, F.posexplode(parts).alias("n", "text")).select(id_, (F.col("n") + 1).alias("n"), F.concat(F.lit("L"), F.col("n") + 1).alias("locator_id"), "text")


#: Runs of line breaks, and white space after a sentence where a capital or an opening mark follows.
_BOUNDARY = r"(?<=\n)(?=[^\n])|(?<=[.!?。！？]\s)(?=[A-Z“\"‘(\[])"


def build_excerpts(locators: DataFrame, keys: Sequence[str], text: str = "text", shortest: int = 8) -> DataFrame:
    """keys, n, quote: contiguous spans whose concatenation is the text. A span shorter than
    ``shortest`` collapsed characters joins the next, a short last one the previous. Each text is
    read once, from its first piece to its last."""

    @F.pandas_udf("array<string>")
    def spans(pieces: pd.Series, sizes: pd.Series) -> pd.Series:
        def one(parts: Sequence[str], ns: Sequence[int]) -> list[str]:
            out, at, held = [], 0, 0
            for i in range(len(parts)):
                held = ns[i] if at == i else size("".join(parts[at : i + 1])) if held + ns[i] < 4 * shortest else held + ns[i]
                if held >= shortest:
                    out.append("".join(parts[at : i + 1]))
                    at, held = i + 1, 0
            rest = "".join(parts[at:])
            return out if not rest else [*out[:-1], out[-1] + rest] if out else [rest]

        return pd.Series([one(p, n) if p is not None else [] for p, n in zip(pieces, sizes, strict=True)])

    space = re.compile(SPACE + "+", re.ASCII)

    def size(x: str) -> int:
        return len(space.sub(" ", x).strip(" "))

    parts = locators.select(*keys, F.split(text, _BOUNDARY).alias("_p"))
    parts = parts.withColumn("_n", F.transform("_p", lambda x: F.length(collapsed(x))))
    return parts.select(*keys, F.posexplode(spans("_p", "_n")).alias("n", "quote")).withColumn("n", F.col("n") + 1)


# fixed values: links in prose
LINK = r"(https?://[^\s<>\"'“”‘’]+)"


def extract_links(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id, url: the links of a text, each once, without trailing marks."""
    urls = F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:!?)\]}。，；：！？）】》]+$", ""))
    return docs.select(id_, F.explode(F.array_distinct(urls)).alias("url"))


def link_references(links: DataFrame, id_: str) -> DataFrame:
    """url, n_sources, first_source."""
    return links.groupBy("url").agg(F.countDistinct(id_).alias("n_sources"), F.min(id_).alias("first_source"))


def unverified_links(links: DataFrame, allowed: DataFrame) -> DataFrame:
    return links.join(allowed.select("url").distinct(), "url", "left_anti")


def numeric_index(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, token, n."""
    return docs.select(id_, F.explode(numeric_tokens(F.col(text))).alias("token")).groupBy(id_, "token").agg(F.count("*").alias("n"))


def document_manifest(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Blocks of each type and the ordered list of ``ord:type``."""
    n = lambda *types: F.count_if(F.col("type").isin(*types))
    items = F.array_sort(F.collect_list(F.struct("ord", "type")))
    return blocks.groupBy(doc).agg(
        n("paragraph", "quote", "list_item").alias("n_paragraphs"), n("heading").alias("n_headings"), n("table").alias("n_tables"), n("figure").alias("n_figures"),
        F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["ord"].cast("string"), x["type"])), ",").alias("manifest"),
    )


def unit_context(units: DataFrame, doc: str, order: str, cut: int = 1200) -> DataFrame:
    """Each unit with its section (last heading at or before it) and its neighbours' text, cut."""
    w = W.partitionBy(doc).orderBy(order)
    section = F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return units.withColumn("section", section).withColumn("before", F.left(F.lag("text").over(w), F.lit(cut))).withColumn("after", F.left(F.lead("text").over(w), F.lit(cut)))


def diff_preserved_blocks(source: DataFrame, target: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """keys, change: missing, added or changed blocks."""
    hashed = lambda d, name: d.select(*keys, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias(name))
    both = hashed(source, "a").join(hashed(target, "b"), list(keys), "full_outer")
    change = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return both.select(*keys, change.alias("change")).filter("change is not null")
