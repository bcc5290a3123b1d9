"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source expects target / size copies. Within the source, documents stand in a
fixed order (size class, block, size, hash); the prefix sums of the expected copies plus one random
offset cross integers, and each crossing emits the document once. Neighbours in that order are of
like size, so that the words taken come within about one document of the target. Targets are
fractions and the sums whole numbers, so no rounding takes a document once too often.

Ranks are dealt by (source, size class, block), not by source: a source with a third of all rows
spreads over hundreds of groups, whose offsets come from a prefix sum over their counts; a size class
with many rows (documents of one size, or empty ones) has as many blocks as its count asks for. Words
are counted once; ids and sizes are written to the shared folder and read back for the counts.

Edge cases: a null text has size 0; a null source is a source of its own, last in the order; sources
without words have target 0; repeated rows are drawn apart from each other; an empty table gives an
empty table; a null doc_id is an id like any other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundwork.llm.lineage import cut
from groundwork.llm.text import WORD, whole


@dataclass(frozen=True)
class Mix:
    """weights: by turns, over the sources in order. share_percent: of all sizes, to be taken in
    sum. cap: times its size that a source gives at most. seed: of the offset. spread: a size class
    of n rows of a source is ranked in 1 + sqrt(n) / spread blocks."""

    weights: tuple[int, ...] = (5, 2, 1)
    share_percent: int = 150
    cap: int = 2
    seed: int = 17
    spread: int = 10


def size_class(size: Column) -> Column:
    """The size itself below 256, else classes of less than one part in 128, in order of size."""
    out = size
    for k in range(1, 40):
        out = F.when(size >= (128 << k), k * 128 + F.shiftright(size, k)).otherwise(out) if k > 1 else F.when(size >= 256, 128 + F.shiftright(size, 1)).otherwise(out)
    return out


def draw(key: Column, seed: int) -> Column:
    """A whole number below 2 ** 32 from a key; any SQL engine with md5 gives the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("long")


WHOLE = "decimal(38,0)"


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size) to (source, source_size, num, den, target); a row for each source.
    target is num / den, whole numbers.

    Filling by weight under caps: with the sources in order of cap / weight, those whose cap is
    below their share of what the ones before leave are capped, the rest share by weight. One row
    for each source meets in one window: sources, unlike documents, are few.
    """
    cap, w = (F.col("source_size") * mix.cap).cast(WHOLE), F.col("_w")
    rank = (F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1) % len(mix.weights)
    weight = F.element_at(F.array(*[F.lit(x) for x in mix.weights]), (rank + 1).cast("int"))
    turns = math.lcm(*mix.weights)
    per_weight = (cap * F.expr(f"{turns} div _w")).cast(WHOLE)
    order = W.orderBy(per_weight.asc(), F.col("source").isNull(), F.col("source"))
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.partitionBy(F.lit(1))
    out = sizes.withColumn("_w", weight).withColumn("_total", (F.sum("source_size").over(all_rows) * mix.share_percent).cast(WHOLE))
    # in hundredths of a word, so that the percentage leaves whole numbers
    out = out.withColumn("_left", (F.col("_total") - F.coalesce(F.sum(cap).over(before), F.lit(0)) * 100).cast(WHOLE))
    out = out.withColumn("_weights", F.sum("_w").over(rest).cast(WHOLE))
    # the first source in order that isn't capped sets the share of all later ones
    out = out.withColumn("_capped", cap * F.col("_weights") * 100 <= F.col("_left") * w)
    out = out.withColumn("_i", F.row_number().over(order))
    free = F.struct(F.col("_left"), F.col("_weights"))
    first = F.min_by(F.when(~F.col("_capped"), free), F.when(~F.col("_capped"), F.col("_i"))).over(all_rows)
    out = out.withColumn("_free", first)
    full = F.col("_capped") | F.col("_free").isNull()
    num = F.when(full, cap).otherwise((F.col("_free._left") * w).cast(WHOLE)).cast(WHOLE)
    den = F.when(full, F.lit(1).cast(WHOLE)).otherwise((F.col("_free._weights") * 100).cast(WHOLE))
    out = out.withColumn("num", num).withColumn("den", den)
    return out.select("source", "source_size", "num", "den", (F.col("num").cast("double") / F.col("den").cast("double")).alias("target"))


def _same(a: DataFrame, b: DataFrame, cols: tuple[str, ...]) -> list[Column]:
    return [a[c].eqNullSafe(b[f"c_{c}"]) for c in cols]


def plan(docs: DataFrame, mix: Mix | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (times the mix takes the document), and the
    columns of ``keep``, which are read again."""
    m = mix or Mix()
    size = F.regexp_count(whole("text"), F.lit(WORD)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"), *keep)
    sized = sized.withColumn("_class", size_class(F.col("size"))).withColumn("_key", draw(F.col("doc_id"), m.seed))
    narrow = cut(sized.drop(*keep))
    by_class = narrow.groupBy("source", "_class").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each source and size class that has several blocks
    blocks = F.lit(1) + F.floor(F.floor(F.sqrt("_n")) / m.spread)
    large = by_class.select(F.col("source").alias("c_source"), F.col("_class").alias("c__class"), blocks.cast("long").alias("_blocks")).filter("_blocks > 1")
    blocked = lambda d: d.join(large, _same(d, large, ("source", "_class")), "left").withColumn("_block", F.col("_key") % F.coalesce("_blocks", F.lit(1))).drop("c_source", "c__class", "_blocks")
    chunk = ("source", "_class", "_block")
    counts = blocked(narrow).groupBy(*chunk).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_size"))
    goal = targets(counts.groupBy("source").agg(F.sum("_size").alias("source_size")), m)
    prior = W.partitionBy("source").orderBy(F.col("_class").desc(), "_block").rowsBetween(W.unboundedPreceding, -1)
    chunks = counts.withColumn("_before", F.coalesce(F.sum("_n").over(prior), F.lit(0))).drop("_n", "_size")
    g = goal.withColumnRenamed("source", "c_source")
    chunks = chunks.join(g, _same(chunks, g, ("source",))).drop("c_source")
    # the offset, below one copy, as a whole number of parts of den * source_size
    unit = (F.col("den") * F.col("source_size")).cast(WHOLE)
    offset = draw(F.coalesce(F.col("source"), F.lit("")), m.seed).cast(WHOLE)
    chunks = chunks.withColumn("_unit", unit).withColumn("_draw", offset).withColumn("_offset", F.expr(f"cast(cast(_unit * _draw as {WHOLE}) div 4294967296 as {WHOLE})"))
    c = chunks.select(*[F.col(x).alias(f"c_{x}") for x in chunk], "_before", "source_size", "target", "num", "_unit", "_offset")
    rows = blocked(sized if keep else narrow)
    rank = F.row_number().over(W.partitionBy(*chunk).orderBy(F.col("size").desc(), "_key", "doc_id"))
    ranked = rows.withColumn("_rank", rank)
    placed = ranked.join(c, _same(ranked, c, chunk)).withColumn("_at", (F.col("_before") + F.col("_rank")).cast("decimal(20,0)"))
    crossed = lambda at: F.expr(f"cast({at} * num + _offset as {WHOLE}) div _unit")
    copies = F.when(F.col("source_size") > 0, crossed("_at") - crossed("(_at - 1)")).otherwise(F.lit(0))
    return placed.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", *keep)


def mix_sources(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with ``copy`` from 1 on.

    The rows are dealt once, whole, so that rows that share a doc_id each take the copies drawn
    for them.
    """
    cols = docs.columns
    packed = docs.select("doc_id", "source", "text", F.struct(*[docs[c] for c in cols]).alias("_all"))
    drawn = plan(packed, mix, keep=("_all",))
    drawn = drawn.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return drawn.select(*[F.col("_all")[c].alias(c) for c in cols if c != "copy"], "copy")
