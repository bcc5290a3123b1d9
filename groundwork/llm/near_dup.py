"""Near-duplicate classes: BagMinHash signatures, banding, and verification of multiset overlap.

1. Documents with the same words are one text (grouped by a digest of the words, counted before the
   shuffle, so that thousands of copies cost as much as one).
2. Each text gets 160 BagMinHash components over its five-word shingles and 32 bands of 5.
3. In each bucket every text is paired with the text that meets most others, the likely original of a
   group of edited copies, and each pair's multisets of shingles are compared. Links join texts to
   components.
4. Texts of buckets that still hold several components are open. What two of them share is bounded by
   the shingles that they have in common with other components at all, and by their overlaps with the
   leader plus their other shingles that any text shares. By these exact bounds, texts (such as those that share only a passage) that cannot reach the threshold
   leave, exactly. The rest is paired with the text that meets most others outside the
   bucket's largest component.
5. What is open after that pairs with the texts of other components of its bucket, where the bound
   allows a link. So every pair of a bucket is compared, excluded by the bound, or already in one
   component, without forming all pairs of a group.

Two texts at a similarity of 0.8 share no bucket with a probability of 3e-6.

Edge cases: words are runs of letters and digits in lower case, so copies that differ in case, white
space or punctuation only are one text; a text of one to four words has one shingle; a text without
words (null, empty, punctuation only) and a row without a doc_id are a class of their own; rows that
share a doc_id are one document in ``classes``, which then is in the class of its smallest text, and
one for each text in ``keep_one``; ids from 2 to the 62 on are taken for others; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundwork.llm.bagminhash import bands, shingles, signatures, weighted
from groundwork.llm.lineage import cut
from groundwork.llm.text import TERM, whole


@dataclass(frozen=True)
class NearDup:
    """small_graph: links up to which a graph is one partition, so that its rounds need no exchange."""

    similarity: float = 0.8
    shingle: int = 5
    components: int = 160
    rows: int = 5
    batch_words: int = 200_000
    small_graph: int = 250_000


_TERMS = re.compile(TERM)


def _banded(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("hashes")
            starts = np.asarray(column.offsets).astype(np.int64)
            flat = np.asarray(column.values).view(np.uint64)[starts[0] : starts[-1]]
            starts = starts - starts[0]
            at = 0
            while at < b.num_rows:  # a slice of bounded words at a time
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + p.batch_words, "right")) - 1)
                sig = signatures(flat[starts[at] : starts[to]], starts[at : to + 1] - starts[at], p.components, p.shingle)
                h = bands(sig, p.rows).view(np.int64)
                n = h.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(h) + 1, n, dtype=np.int32)), pa.array(h.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[at:to], b.column("key")[at:to], lists, pa.array(np.maximum(np.diff(starts[at : to + 1]) - p.shingle + 1, 1))], names=["doc_id", "key", "bands", "size"])
                at = to

    return run


def _bag_rows(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("hashes")
            starts = np.asarray(column.offsets).astype(np.int64)
            flat = np.asarray(column.values).view(np.uint64)[starts[0] : starts[-1]]
            starts, reps, roots = starts - starts[0], b.column("rep").to_numpy(), b.column("root").to_numpy()
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + p.batch_words, "right")) - 1)
                x, own, w = weighted(*shingles(flat[starts[at] : starts[to]], starts[at : to + 1] - starts[at], p.shingle))
                yield pa.RecordBatch.from_arrays([pa.array(reps[at:to][own]), pa.array(roots[at:to][own]), pa.array(x.view(np.int64)), pa.array(w)], names=["rep", "root", "h", "w"])
                at = to

    return run


def _weights(texts: DataFrame, p: NearDup) -> DataFrame:
    """(rep, own, met) of ``texts`` (rep, root, text): how many of a text's shingles, repeats counted,
    no other text has, and how many a text of another component has."""
    ws = F.regexp_extract_all("text", F.lit(f"({TERM})"), F.lit(1))
    hashed = texts.select("rep", "root", F.transform(ws, lambda w: F.xxhash64(w)).alias("hashes"))
    rows = hashed.mapInArrow(_bag_rows(p), "rep long, root long, h long, w long").repartition("h")  # once, for the groups and the join
    by = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    kind = by.filter("n = 1 or low <> high").select("h", "n")
    each = rows.join(kind.hint("merge"), "h")
    sums = lambda one: F.sum(F.when(F.col("n") == 1 if one else F.col("n") > 1, F.col("w")).otherwise(0))
    return each.groupBy("rep").agg(sums(True).alias("own"), sums(False).alias("met"))


#: Members of a bucket that meet what is told of their bucket in one task, about.
TOGETHER = 256


def _with(members: DataFrame, told: DataFrame, who: str = "rep") -> DataFrame:
    """``members`` (bucket, n, ...) with the rows that ``told`` (bucket, n, ...) has of their bucket. n is
    the bucket's size: a bucket with many members is dealt in as many parts as that asks for, and what
    is told of it is there for each part."""
    parts = F.expr(f"n div {TOGETHER}")
    left = members.withColumn("_part", F.pmod(F.xxhash64(who), parts + 1))
    right = told.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts))).drop("n")
    return left.join(right, ["bucket", "_part"]).drop("_part")


def _open(members: DataFrame) -> DataFrame:
    """The members (rep, bucket, n, root, ...) of buckets that hold several components."""
    several = members.groupBy("bucket").agg(F.max("n").alias("n"), F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high")
    return _with(members, several.select("bucket", "n"))


def banded(docs: DataFrame, p: NearDup) -> DataFrame:
    """doc_id, key (digest of the words) and bands of every document that has words."""
    ws = F.regexp_extract_all(F.lower(whole("text")), F.lit(f"({TERM})"), F.lit(1))
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), ws.alias("ws")).filter(F.col("doc_id").isNotNull() & (F.size("ws") > 0))
    d = d.select("doc_id", F.md5(F.array_join("ws", " ")).alias("key"), F.transform("ws", lambda w: F.xxhash64(w)).alias("hashes"))
    return d.mapInArrow(_banded(p), "doc_id long, key string, bands array<long>, size long")


def _similar(p: NearDup):
    def bag(text: str) -> Counter:
        ws = _TERMS.findall(text)  # in lower case
        return Counter(zip(*(ws[j:] for j in range(p.shingle)), strict=False)) if len(ws) >= p.shingle else Counter([tuple(ws)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, of = None, Counter()
        for f in frames:
            shared, ok = [], []
            for a, x, y in zip(f["a"], f["text_a"], f["text_b"], strict=True):
                if a != last:
                    last, of = a, bag(x)
                other = bag(y)
                small, large = (of, other) if len(of) <= len(other) else (other, of)
                both = sum(min(n, large[s]) for s, n in small.items() if s in large)
                shared.append(both)
                ok.append(both >= p.similarity * (of.total() + other.total() - both) - 1e-9)
            yield f[["a", "b"]].assign(shared=shared, ok=ok)

    return run


def compared(pairs: DataFrame, texts: DataFrame, p: NearDup) -> DataFrame:
    """(a, b, shared, ok): the pairs with the size of the overlap of their multisets of shingles and
    whether it reaches the similarity. The text of b, which has few pairs, is met first; the text of
    a then joins by a key that Spark may split."""
    t = texts.select(F.col("rep"), "text")
    both = pairs.join(t.withColumnsRenamed({"rep": "b", "text": "text_b"}), "b").join(t.withColumnsRenamed({"rep": "a", "text": "text_a"}), "a")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(_similar(p), "a long, b long, shared long, ok boolean")


def components(links: DataFrame, most: int = NearDup.small_graph) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b), root the smallest node of its component: large
    stars and small stars by turns until nothing moves. Stars come from grouped minima and joins;
    each round is written to the shared folder. A graph of at most ``most`` links, as counted, is
    held in one partition; a larger one is dealt by node."""
    edges, seen = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), None
    while True:
        edges = cut(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = now
        if now[0] <= most:
            edges = edges.coalesce(1)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.coalesce(1) if now[0] <= most else both
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = (small.coalesce(1) if now[0] <= most else small).filter("u > v").distinct()


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def classes(docs: DataFrame, p: NearDup | None = None) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of the class), a row for each document."""
    p = p or NearDup()
    return _placed(docs, p)[0]


#: From here on numbers of texts that share their doc_id with other texts; real ids are smaller.
CLASHING = 1 << 62


def _keyed(text: Column) -> Column:
    """The digest of a text's words."""
    return F.md5(F.array_join(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1)), " "))


def _placed(docs: DataFrame, p: NearDup) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id) for each doc_id, and (doc_id, key) of the texts that are not the first of
    their class. Where a doc_id has several texts, each is a node of its own."""
    made = cut(banded(docs, p))
    several = made.groupBy("doc_id").agg(F.min("key").alias("_low"), F.max("key").alias("_high")).filter("_low <> _high").select("doc_id", F.lit(True).alias("_clash"))
    clashes = several.count()
    several = F.broadcast(several) if clashes <= 100_000 else several  # ids, as counted
    node = F.when(F.col("_clash"), CLASHING + F.pmod(F.xxhash64("doc_id", "key"), F.lit(CLASHING))).otherwise(F.col("doc_id"))
    marked = lambda d: d.join(several, "doc_id", "left") if clashes else d.withColumn("_clash", F.lit(False))
    made = marked(made).withColumn("node", node).drop("_clash")
    reps = cut(made.groupBy("key").agg(F.min("node").alias("rep"), F.first("bands").alias("bands"), F.first("size").alias("size")))
    member = reps.select("rep", "size", F.posexplode("bands").alias("band", "bucket"))
    # buckets of more than one text, each led by the text that shares buckets with most others: the
    # original of a group of edited copies meets them more often than they meet each other
    held = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(_ranked(member.select("rep", "size", "bucket").join(held, "bucket")))
    lead = cut(shared.groupBy("bucket").agg(F.max("n").alias("n"), F.max(F.struct("rank", "rep"))["rep"].alias("leader")))
    first = _pairs(_with(shared.select("bucket", "n", "rep"), lead).filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")))
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole("text").alias("text"))
    source = marked(source)
    source = source.withColumn("key", F.when(F.col("_clash"), _keyed(F.col("text")))).select(node.alias("rep"), F.lower("text").alias("text"))
    met = source.join(shared.select("rep").distinct(), "rep", "left_semi")
    one = W.partitionBy("rep").orderBy(F.lit(0))  # rows of one node have the same words
    texts = cut(met.withColumn("_i", F.row_number().over(one)).filter("_i = 1").drop("_i"))
    tested = cut(compared(first, texts, p))
    links = tested.filter("ok").select("a", "b")
    roots = components(links, p.small_graph)
    open_ = cut(_open(_rooted(shared, roots)))
    if open_.take(1):
        weights = cut(_weights(texts.join(open_.select("rep", "root").distinct(), "rep"), p))
        seen = tested.select("a", "b", "shared").union(tested.select("b", "a", "shared")).toDF("rep", "leader", "with_leader")
        held = _with(open_, lead).join(seen, ["rep", "leader"], "left").join(weights, "rep")
        leads = F.col("rep") == F.col("leader")
        held = held.withColumn("with_leader", F.when(leads, F.col("size")).otherwise(F.col("with_leader")))
        held = held.withColumn("apart", F.when(leads, 0).otherwise(F.col("size") - F.col("with_leader") - F.col("own")))
        open_ = cut(_open(held.filter(F.col("met") >= p.similarity * F.col("size"))))
        for step in (_second, _crossing):
            pairs = cut(step(open_, p).join(first, ["a", "b"], "left_anti"))
            first = first.union(pairs)
            links = links.union(cut(compared(pairs, texts, p)).filter("ok").select("a", "b"))
            roots = components(links, p.small_graph)
            open_ = cut(_open(_rooted(open_.drop("root"), roots)))
    named = _rooted(reps.select("key", "rep"), roots).select("key", "root")
    texts_in = made.select("doc_id", "key", "node").join(named, "key").withColumn("class", F.col("root"))
    later = texts_in.filter("doc_id <> root").select("doc_id", "key")
    if clashes:
        texts_in = cut(texts_in)
        # a root is the smallest doc_id of a class but for clashing texts, whose nodes are no ids
        own = texts_in.filter(F.col("node") >= CLASHING).groupBy("root").agg(F.min("doc_id").alias("_own"))
        texts_in = texts_in.join(own, "root", "left").withColumn("class", F.least("_own", "root"))
        first = texts_in.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("_first"))
        later = texts_in.join(first, "root").filter((F.col("doc_id") != F.col("_first.doc_id")) | (F.col("key") != F.col("_first.key"))).select("doc_id", "key")
    placed = texts_in.groupBy("doc_id").agg(F.min("class").alias("class_id"))
    lone_docs = docs.select(docs["doc_id"].cast("long").alias("doc_id")).join(placed.select("doc_id"), "doc_id", "left_anti").distinct()
    return placed.unionByName(lone_docs.select("doc_id", F.col("doc_id").alias("class_id"))), later


def _pairs(rows: DataFrame) -> DataFrame:
    return cut(rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


OF_BOUND = ("root", "size", "met", "with_leader", "apart")


def _may_link(p: NearDup):
    """The bound on what two texts of a bucket share: neither more than either has in common with
    other components, nor more than the smaller overlap with the bucket's leader plus the smaller of
    their other shingles that any text shares."""
    near = F.least("with_leader_a", "with_leader_b") + F.least("apart_a", "apart_b")
    most = F.least(F.col("met_a"), F.col("met_b"), near)
    return most >= p.similarity * (F.col("size_a") + F.col("size_b") - most) - 1e-9


def _side(members: DataFrame, x: str) -> DataFrame:
    return members.select("bucket", "n", F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in OF_BOUND])


def _ranked(members: DataFrame) -> DataFrame:
    """The members (rep, bucket, n) with rank: how many others the text meets over all buckets."""
    rank = members.groupBy("rep").agg(F.sum("n").alias("rank"))
    return members.join(rank, "rep")


def _main(open_: DataFrame) -> DataFrame:
    """(bucket, n, main): the largest component of each bucket."""
    by = open_.groupBy("bucket", "root").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    return by.groupBy("bucket").agg(F.max("n").alias("n"), F.max(F.struct("k", "root"))["root"].alias("main"))


def _second(open_: DataFrame, p: NearDup) -> DataFrame:
    """Pairs of each open text with the text of highest rank outside its bucket's largest component."""
    order = F.struct("rank", "rep", *OF_BOUND)
    hub = _with(open_, _main(open_)).filter("root <> main").groupBy("bucket").agg(F.max("n").alias("n"), F.max(order).alias("hub"))
    hub = hub.select("bucket", "n", F.col("hub.rep").alias("a"), *[F.col(f"hub.{c}").alias(f"{c}_a") for c in OF_BOUND])
    return _pairs(_with(_side(open_, "b"), hub, "b").filter((F.col("root_a") != F.col("root_b")) & _may_link(p)))


def _crossing(open_: DataFrame, p: NearDup) -> DataFrame:
    """Pairs of the texts outside a bucket's largest component with those of its other components."""
    outer = _side(_with(open_, _main(open_)).filter("root <> main"), "a")
    return _pairs(_with(_side(open_, "b"), outer, "b").filter((F.col("root_a") != F.col("root_b")) & _may_link(p)))


def keep_one(docs: DataFrame, p: NearDup | None = None) -> DataFrame:
    """The documents without all but the first of each class, in the columns of ``docs``: by doc_id,
    then by text. Of rows that share a doc_id, those with other words are documents of their own, those
    with the same words are one; rows without a doc_id stay."""
    later = cut(_placed(docs, p or NearDup())[1].select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")))
    packed = docs.select(docs["doc_id"].cast("long").alias("_id"), _keyed(whole("text")).alias("_key"), F.struct(*[docs[c] for c in docs.columns]).alias("_all"))
    known = packed.filter("_id is not null").join(later, ["_id", "_key"], "left_anti")
    one = W.partitionBy("_id", "_key").orderBy(F.md5(F.coalesce(F.col("_all.text"), F.lit(""))))
    kept = known.withColumn("_row", F.row_number().over(one)).filter("_row = 1").drop("_row")
    return kept.unionByName(packed.filter("_id is null")).select(*[F.col("_all")[c].alias(c) for c in docs.columns])
