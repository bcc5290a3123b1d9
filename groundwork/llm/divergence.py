"""Source divergence audit: how far the sources of a language stand apart, and by which terms.

A term row is a kept term of a language with its count in each source that has it, in the order of the
sources. The value of a pair of sources is a sum over all kept terms, nearly all of which are in few
sources, so it is formed as

    V * f(0, 0)                                 as if no term occurred in either,
    + for each term of A: f(a, 0) - f(0, 0)     from how often A has each count, the same for B,
    + for each term of both: f(a, b) - f(a, 0) - f(0, b) + f(0, 0).

The last part comes from a frequent-pattern tree: term rows are paths of (source, count) nodes, the
sources that have most terms first, so that rows share their beginnings; equal rows are inserted once,
with their multiplicity. A node and an ancestor of it give their pair's correction once, times the rows
that pass the node, however many they are.

Rows are dealt by their first nodes and sorted, so each task receives the paths of its subtrees in order
and makes the tree of a batch of them at a time; sums over trees add up. All are of whole numbers and
exact.

Edge cases: text, lang and source that are null count as empty; a language whose terms are all too rare
has V = 0 and pairs of value 0; a source without kept terms still has a share for each; a single source
has no pairs; repeated rows are documents each; equal values go by the item's UTF-8; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundwork.llm.lineage import cut


@dataclass(frozen=True)
class Audit:
    """least: documents of its language that a term needs. top: ranks of terms. held: counts that a task holds
    before it hands them on; pairs: nodes with their ancestors that it takes together. parts: by which terms of a source are dealt where each
    meets the other sources of its language."""

    least: int = 10
    top: int = 10
    held: int = 1_000_000
    pairs: int = 500_000
    parts: int = 64


#: Bytes of UTF-8 as they count in terms: letters lower-cased, all beyond ASCII, anything else a blank.
_BYTES = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
WHOLE = 1_000_000_000


def _counted(held: int):
    """Counts and documents of each term by language and source, from texts."""

    def out(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), of in counts.items():
            seen, m = docs[lang, source], len(of)
            columns = [pa.array([lang] * m, pa.string()), pa.array([source] * m, pa.string()), pa.array(of.keys(), pa.string()), pa.array(of.values(), pa.int64()), pa.array(map(seen.__getitem__, of), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, size = defaultdict(Counter), defaultdict(Counter), 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
                terms = text.as_buffer().to_pybytes().translate(_BYTES).split()
                total = counts[lang, source]
                size -= len(total)
                total.update(terms)
                docs[lang, source].update(set(terms))
                size += len(total)
                if size > held:
                    yield from out(counts, docs)
                    counts, docs, size = defaultdict(Counter), defaultdict(Counter), 0
        yield from out(counts, docs)

    return run


def term_counts(docs: DataFrame, p: Audit) -> DataFrame:
    """lang, term, sources: array of (source, n), for each kept term; a row each."""
    d = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = d.mapInArrow(_counted(p.held), "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    each = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return by.filter(F.col("docs") >= p.least).drop("docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (n + 2) / (total + 2 * terms)), exact for any counts; null where there are no
    terms."""
    of = total.cast("decimal(25,0)") + terms.cast("decimal(25,0)") * F.lit(2).cast("decimal(2,0)")
    top = (n.cast("decimal(24,0)") + F.lit(2).cast("decimal(2,0)")) * F.lit(WHOLE).cast("decimal(10,0)")
    return F.when(terms > 0, F.call_function("div", top, of) + 1).cast("long")


def apart(a: Column, b: Column) -> Column:
    """floor((a - b)^2 / (a + b)) of two shares."""
    return F.call_function("div", (a - b) * (a - b), a + b)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a - b) * (a - b) // (a + b)


def _nodes(langs: np.ndarray, starts: np.ndarray, at: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of the tree of sorted paths: a row that has it, its depth, the rows through it."""
    sizes, m = np.diff(starts), len(n)
    row = np.repeat(np.arange(m), sizes)
    depth = np.arange(len(at)) - starts[row]
    other = starts[np.maximum(row - 1, 0)] + depth
    there = (row > 0) & (depth < sizes[np.maximum(row - 1, 0)])
    other = np.where(there, other, 0)
    same = there & (at == at[other]) & (p == p[other]) & (langs[row] == langs[np.maximum(row - 1, 0)])
    shared = np.minimum.reduceat(np.where(same, sizes[row], depth), starts[:-1]).tolist()
    through, long = np.r_[0, np.cumsum(n)].tolist(), sizes.tolist()
    open_, found = [], []
    for i in range(m + 1):
        keep = shared[i] if i < m else 0
        while len(open_) > keep:
            of = open_.pop()
            found.append((of, len(open_), through[i] - through[of]))
        if i < m:
            open_ += [i] * (long[i] - keep)
    return tuple(np.array(x) for x in zip(*found, strict=True))


def _tree(held: int):
    """Sums of pair corrections (lang, a, b, v) from sorted paths with their multiplicity, by the tree of
    each batch. A path is an array of (at, p, p0): a source's place, its share for the count and its
    share for none; none is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column, langs = batch.column("path"), batch.column("lang").dictionary_encode()
            starts = np.asarray(column.offsets).astype(np.int64)
            at, p, p0 = (column.values.field(c).to_numpy()[starts[0] : starts[-1]].astype(np.int64) for c in ("at", "p", "p0"))
            starts, codes = starts - starts[0], langs.indices.to_numpy().astype(np.int64)
            row, depth, n = _nodes(codes, starts, at, p, batch.column("n").to_numpy())
            ends = np.cumsum(depth)
            i = 0
            while i < len(row):  # as many nodes as have about ``held`` ancestors
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + held, "right")))
                up = depth[i:j]
                node = np.repeat(starts[row[i:j]] + up, up)
                over = np.arange(len(node)) - np.repeat(np.cumsum(up) - up, up) + np.repeat(starts[row[i:j]], up)
                v = _apart(p[over], p[node]) - _apart(p[over], p0[node]) - _apart(p0[over], p[node]) + _apart(p0[over], p0[node])
                f = pd.DataFrame({"lang": np.repeat(codes[row[i:j]], up), "a": at[over].astype(np.int32), "b": at[node].astype(np.int32), "v": v * np.repeat(n[i:j], up)})
                f = f.groupby(["lang", "a", "b"], as_index=False)["v"].sum()
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(f["lang"])), pa.array(f["a"]), pa.array(f["b"]), pa.array(f["v"])], names=["lang", "a", "b", "v"])
                i = j

    return run


def audit(docs: DataFrame, p: Audit | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: the pairs of each source and its foremost terms."""
    p = p or Audit()
    kept = cut(term_counts(docs, p))
    flat = kept.select("lang", "term", F.explode("sources").alias("s")).select("lang", "term", "s.source", "s.n")
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    met = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("had"))
    all_ = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = all_.join(met, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "had", "terms"])
    order = W.partitionBy("lang").orderBy(F.col("had").desc(), "source")
    groups = groups.select("lang", "source", "total", "terms", F.row_number().over(order).alias("at"), share(F.lit(0), F.col("total"), F.col("terms")).alias("p0"))
    groups = cut(groups)
    shares = flat.join(groups, ["lang", "source"]).select("lang", "term", "source", "at", "p0", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "n")
    rank = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return _pairs(shares, groups, p).withColumn("rank", F.row_number().over(rank)).unionByName(_terms(shares, groups, p).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= p.top))


def _terms(shares: DataFrame, groups: DataFrame, p: Audit) -> DataFrame:
    """Terms that a source has more of than its language."""
    whole = shares.groupBy("lang", "term").agg(F.sum("n").alias("all"))
    sizes = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    of = whole.join(sizes, "lang").select("lang", "term", share(F.col("all"), F.col("total"), F.col("terms")).alias("q"))
    over = shares.join(of, ["lang", "term"]).filter(F.col("p") > F.col("q"))
    return over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))


def _pairs(shares: DataFrame, groups: DataFrame, p: Audit) -> DataFrame:
    """Each source with each other one of its language."""
    g, part = groups.select("lang", "at", "p0", "terms"), F.pmod(F.xxhash64("a", "p"), F.lit(p.parts))
    two = g.select("lang", F.col("at").alias("a"), F.col("p0").alias("za"), "terms").join(g.select("lang", F.col("at").alias("b"), F.col("p0").alias("zb")), "lang").filter("a < b")
    none = two.select("lang", "a", "b", F.coalesce(F.col("terms") * apart(F.col("za"), F.col("zb")), F.lit(0)).alias("v"))

    had = shares.groupBy("lang", F.col("at").alias("a"), F.col("p0").alias("za"), "p").agg(F.count("*").alias("n")).withColumn("part", part)
    others = g.select("lang", F.col("at").alias("b"), F.col("p0").alias("zb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p.parts - 1).cast("long"))).alias("part"))
    single = had.join(others, ["lang", "part"]).filter("a <> b")
    single = single.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("n") * (apart(F.col("p"), F.col("zb")) - apart(F.col("za"), F.col("zb")))).alias("v"))

    rows = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("at", "p", "p0"))).alias("path"))
    rows = rows.filter(F.size("path") > 1).groupBy("lang", "path").agg(F.count("*").alias("n"))
    rows = rows.repartition("lang", F.slice("path", 1, 3)).sortWithinPartitions("lang", "path")
    both = rows.mapInArrow(_tree(p.pairs), "lang string, a int, b int, v long")

    sums = none.unionByName(single).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("other")), F.struct(F.col("b").alias("at"), F.col("a").alias("other")))).alias("w")
    named = groups.select("lang", "at", "source")
    mirrored = sums.select("lang", "value", ways).select("lang", "value", "w.at", "w.other").join(named, ["lang", "at"]).join(named.select("lang", F.col("at").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    return mirrored.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
