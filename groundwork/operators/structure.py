"""Structure of documents: lines, fences, headings, sections, numbering, assembly, formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def markdown_lines(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n, line, in_code: lines with the parity of the fences at or before them."""
    lines = docs.select(id_, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line"))
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    marks = F.sum(F.when(fence, 1).otherwise(0)).over(W.partitionBy(id_).orderBy("n"))
    return lines.withColumn("in_code", (marks % 2 == 1) | fence)


#: An item: its indent, its mark and its text. A picture: its label, address and title.
ITEM = r"^(\s*)([-*+]|\d+[.)])\s+(.*)$"
PICTURE = r"^\s*!\[([^\]]*)\]\(([^)\s]+)(?:\s+\"([^\"]*)\")?\)\s*$"


def _in_display(line: Column, in_code: Column, w: WindowSpec) -> tuple[Column, Column]:
    """Whether a line is of a display formula: from a line that begins with $$ to one that ends with $$.
    A line sets the state (it opens and does not close), resets it (it closes), turns it ($$ alone) or
    leaves it, so the state after a line is told by the last that sets or resets and the turns since."""
    t = F.when(in_code, F.lit("")).otherwise(F.regexp_replace(line, r"^\s+|\s+$", ""))
    opens, closes, alone = t.startswith("$$"), t.endswith("$$"), t == "$$"
    fixed = F.when(alone, None).when(closes, 0).when(opens, 1)
    turns = F.sum(F.when(alone, 1).otherwise(0)).over(w)
    last = F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("s"), turns.alias("k"))), ignorenulls=True).over(w)
    after = (F.coalesce(last["s"], F.lit(0)) + turns - F.coalesce(last["k"], F.lit(0))) % 2
    return after, opens


def markdown_blocks(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ord, type, level, text, ordered, ordinal, delimiter, depth, src, caption: headings, lists,
    quotes, tables, code, pictures and display formulas of Markdown; other lines in a row are one
    paragraph. The text of an item is its whole line, its number, mark and depth (two blanks a step)
    stand beside it; the text of a formula is without its marks."""
    w = W.partitionBy(id_).orderBy("n")
    rows = markdown_lines(docs, id_, text)
    after, opens = _in_display(F.col("line"), F.col("in_code"), w)
    rows = rows.withColumn("_after", after).withColumn("_opens", opens & ~F.col("in_code"))
    before = F.coalesce(F.lag("_after").over(w), F.lit(0))
    rows = rows.withColumn("_math", (before == 1) | F.col("_opens")).withColumn("_first", (before == 0) & F.col("_opens"))
    n = F.col("line")
    kind = (
        F.when(F.col("in_code"), "code").when(F.col("_math"), "equation").when(n.rlike(r"^\s*$"), None).when(n.rlike(r"^#{1,6}\s"), "heading").when(n.rlike(r"^\s*([-*+]|\d+[.)])\s"), "list_item")
        .when(n.rlike(r"^\s*>"), "quote").when(n.rlike(r"^\s*\|.*\|\s*$"), "table").when(n.rlike(PICTURE), "figure").otherwise("paragraph")
    )
    rows = rows.withColumn("type", kind)
    alone = F.col("type").isin("heading", "list_item", "figure") | F.col("_first")
    new = F.when(alone | F.lag("type").over(w).isNull() | (F.lag("type").over(w) != F.col("type")), 1).otherwise(0)
    rows = rows.withColumn("ord", F.sum(new).over(w)).filter("type is not null")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    by = rows.groupBy(id_, "ord").agg(F.first("type").alias("type"), F.min("n").alias("n"), F.array_join(lines, "\n").alias("text"))
    is_ = lambda t: F.col("type") == t
    level = F.when(is_("heading"), F.length(F.regexp_extract("text", "^(#+)", 1)))
    mark, number = F.regexp_extract("text", ITEM, 2), F.regexp_extract("text", r"^\s*(\d+)[.)]\s", 1)
    ordered = F.when(is_("list_item"), number != "")
    part = lambda i: F.nullif(F.regexp_extract("text", PICTURE, i), F.lit(""))
    bare = F.when(is_("heading"), F.trim(F.regexp_replace("text", "^#+", ""))).when(is_("equation"), F.regexp_replace(F.regexp_replace("text", r"^\s*\$\$\s*", ""), r"\s*(?:\$\$)?\s*\z", "")).otherwise(F.col("text"))
    return by.select(
        id_, F.row_number().over(W.partitionBy(id_).orderBy("n")).alias("ord"), "type", level.alias("level"), bare.alias("text"), ordered.alias("ordered"), F.when(ordered, F.try_to_number(number, F.lit("9" * 18)).cast("long")).alias("ordinal"), F.when(ordered, F.right(mark, F.lit(1))).alias("delimiter"),
        F.when(is_("list_item"), F.floor(F.length(F.regexp_extract("text", ITEM, 1)) / 2).cast("int")).alias("depth"), F.when(is_("figure"), part(2)).alias("src"), F.when(is_("figure"), F.coalesce(part(3), part(1))).alias("caption"),
    ).filter((F.col("type") != "equation") | (F.col("text") != ""))


def list_numbers(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The items with list (which run of items they are of) and path: the numbers of the items around an
    item and its own, counted under the one above from each list's first ordinal on. A block of another
    type ends a list; an item that is less deep ends the deeper ones."""
    w = W.partitionBy(doc).orderBy("ord")
    b = blocks.withColumn("_run", F.sum(F.when(F.col("type") == "list_item", 0).otherwise(1)).over(w)).filter("type = 'list_item'")
    b = b.withColumn("_d", F.least(F.coalesce("depth", F.lit(0)), F.lit(MOST_DEPTH)))
    own = W.partitionBy(doc, "_run").orderBy("ord")
    for n in range(MOST_DEPTH + 1):  # items of a depth since the last one that is less deep
        b = b.withColumn(f"_a{n}", F.coalesce(F.max(F.when(F.col("_d") < n, F.col("ord"))).over(own), F.lit(-1)))
        each = W.partitionBy(doc, "_run", f"_a{n}").orderBy("ord")
        first = F.first(F.when((F.col("_d") == n) & F.coalesce("ordered", F.lit(False)), F.col("ordinal")), ignorenulls=True).over(each)
        count = F.count_if(F.col("_d") == n).over(each)
        b = b.withColumn(f"_n{n}", F.when((F.col("_d") >= n) & (count > 0), count + F.coalesce(first, F.lit(1)) - 1))
    path = F.filter(F.array(*[F.col(f"_n{n}") for n in range(MOST_DEPTH + 1)]), lambda x: x.isNotNull())
    return b.select(*blocks.columns, F.dense_rank().over(W.partitionBy(doc).orderBy("_run")).alias("list"), path.alias("path"))


#: Depth from which on items count as equally deep.
MOST_DEPTH = 5


def number_visuals(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Figures and tables counted in a document; references counted anew after any other block."""
    w = W.partitionBy(doc).orderBy("ord")
    count = lambda t: F.sum(F.when(F.col("type") == t, 1).otherwise(0)).over(w)
    is_ref = F.col("type") == "reference"
    b = blocks.withColumn("_run", F.sum(F.when(is_ref, 0).otherwise(1)).over(w))
    ref = F.row_number().over(W.partitionBy(doc, "_run", is_ref).orderBy("ord"))
    number = F.when(F.col("type") == "figure", count("figure")).when(F.col("type") == "table", count("table")).when(is_ref, ref)
    return b.withColumn("number", number).drop("_run")


def flatten_documents(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, text: the blocks' texts in order, blank lines between."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return blocks.groupBy(doc).agg(F.array_join(F.filter(parts, lambda x: F.trim(x) != ""), "\n\n").alias("text"))


def assemble_articles(items: DataFrame, issue: str = "issue_date") -> DataFrame:
    """issue, title, markdown of the items (ord, heading, body, sources) in order."""
    part = F.concat(F.lit("## "), F.col("heading"), F.lit("\n\n"), F.trim(F.regexp_replace("body", r"\n{3,}", "\n\n")), F.when(F.size("sources") > 0, F.concat(F.lit("\n\n"), F.array_join("sources", "\n"))).otherwise(""))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("md")))), lambda x: x["md"])
    return items.groupBy(issue).agg(F.count("*").alias("n_items"), F.array_join(rows, "\n\n").alias("markdown"))


#: Marks of TeX, without which a pair of dollars is taken for money.
TEX = r"[\\^_{}=+<>]|(?<![A-Za-z])[A-Za-z](?![A-Za-z])"


def extract_formulas(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n, kind, tex: display and inline formulas outside of fences and inline code; pairs of
    dollars around money are not formulas."""
    prose = markdown_lines(docs, id_, text).filter("not in_code")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    whole = prose.groupBy(id_).agg(F.regexp_replace(F.array_join(lines, "\n"), r"`[^`\n]*`", "").alias("t"))
    p = r"(?s)(\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|(?<![\\$])\$(?![\s$])[^$\n]+?(?<![\s\\])\$(?![\d$]))"
    rows = whole.select(id_, F.posexplode(F.regexp_extract_all("t", F.lit(p), F.lit(1))).alias("n", "raw"))
    kind = F.when(F.col("raw").startswith("$$") | F.col("raw").startswith("\\["), "display").otherwise("inline")
    inner = F.when(F.col("raw").rlike(r"^\$[^$]"), F.substring(F.col("raw"), F.lit(2), F.length("raw") - 2)).otherwise(F.substring(F.col("raw"), F.lit(3), F.length("raw") - 4))
    rows = rows.select(id_, "n", kind.alias("kind"), F.trim(inner).alias("tex")).filter((F.col("kind") == "display") | F.col("tex").rlike(TEX))
    twin = F.lead(F.struct("kind", "tex")).over(W.partitionBy(id_).orderBy("n"))
    return rows.withColumn("_next", twin).filter(~((F.col("kind") == "inline") & F.coalesce((F.col("_next.kind") == "display") & (F.col("_next.tex") == F.col("tex")), F.lit(False)))).drop("_next")


def ground_formulas(bodies: DataFrame, locators: DataFrame, key: str = "card_id") -> DataFrame:
    """Formulas of bodies (key, tex) that no formula locator (key, tex) has, white space apart."""
    tight = lambda c: F.regexp_replace(c, r"\s+", "")
    known = locators.select(key, tight("tex").alias("_tex")).distinct()
    return bodies.withColumn("_tex", tight("tex")).join(known, [key, "_tex"], "left_anti").drop("_tex")


def translation_units(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Text blocks, and captions of figures and tables, that are to be translated."""
    rows = blocks.filter("coalesce(translation_policy, '') <> 'preserve-original'")
    body = rows.filter(F.col("type").isin("heading", "paragraph", "quote", "list_item")).select(doc, F.concat(F.lit("b"), F.col("ord").cast("string")).alias("unit_id"), F.lit("text").alias("kind"), "text")
    caption = rows.filter(F.col("type").isin("figure", "table") & (F.coalesce("caption", F.lit("")) != "")).select(doc, F.concat(F.lit("c"), F.col("ord").cast("string")).alias("unit_id"), F.lit("caption").alias("kind"), F.col("caption").alias("text"))
    return body.unionByName(caption)

