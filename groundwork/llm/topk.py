"""Exact top-k search by inner product: a three-phase uniform threshold.

A score is the sum of local scores, one for each of ``lists`` slices of the dimensions.

1. Gather: over a share of the rows, each slice lists k rows of highest local score for each query; the
   k-th best of the total scores of what the lists name is a safe cutoff.
2. Collect: the cutoffs go out with the queries. A row whose total is to reach a cutoff of t has a local
   score of at least t / lists in some slice, so that only those entries are looked at again.
3. Resolve: the other local scores of these entries are added exactly, and only what is really above
   the cutoff leaves its task.

The first phase reads a few thousand rows. The others read all rows in rounds, each up to ``growth``
times as many rows as before; a round meets the cutoffs that the rounds before have raised. So a query
gets about k * growth entries in a round, however many rows and tasks there are. Queries are taken in groups of counted size, which are what is
broadcast; each group passes over the rows in blocks. Rounds are dealt by a hash of the key: a third of
all rows may be one vector, as ties go by key and only keys before the cutoff's are sent.

Edge cases: vectors that are null or hold a null or non-finite entry take no part; a vector shorter than
another counts as if zeros followed; equal scores go by the smaller key, keys that are null last; rows
that share the query's key are its own and no candidates; repeated rows are candidates each and ask
once; different vectors under one key ask each and are ranked each; scores beyond
long count as the nearest long; fewer rows than k give all there are; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundwork.llm.lineage import cut
from groundwork.llm.vectors import LONG, largest, matrix, scaled, to_long


@dataclass(frozen=True)
class TopK:
    """scale: of the whole numbers. lists: slices of the dimensions. group: most queries that are
    broadcast at once. first: rows of the first round, about. block: rows and queries that are scored
    together."""

    k: int = 10
    scale: int = 1024
    lists: int = 4
    group: int = 16_384
    first: int = 4096
    growth: int = 16
    block: int = 1024


@dataclass(frozen=True)
class _Asked:
    """The queries of a group, by key. scores, keys: their cutoffs; a query without one has the least
    score and the largest key."""

    at: np.ndarray
    vectors: np.ndarray
    scores: np.ndarray
    keys: np.ndarray


def _exact(x: np.ndarray, q: np.ndarray) -> type:
    """The type in which all inner products of ``x`` and ``q`` are exact."""
    most = largest(x) * largest(q) * x.shape[1]
    return np.float64 if most < 2**53 else np.int64 if most <= LONG else object


def _local(x: np.ndarray, q: np.ndarray, lists: int) -> list[np.ndarray]:
    """The local scores of rows ``x`` for queries ``q``, a matrix (queries, rows) for each slice."""
    kind, edges = _exact(x, q), np.linspace(0, x.shape[1], lists + 1).astype(int)
    x, q = x.astype(kind), q.astype(kind)
    return [q[:, a:b] @ x[:, a:b].T for a, b in itertools.pairwise(edges) if b > a] or [np.zeros((len(q), len(x)), np.int64)]


def _named(local: list[np.ndarray], own: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among ``k`` of the highest of a slice, the query's own left out."""
    if own.shape[1] <= k:
        return ~own
    out = np.zeros(own.shape, bool)
    for part in local:
        np.put_along_axis(out, np.argpartition(np.where(own, -np.inf, part.astype(np.float64)), -k, axis=1)[:, -k:], True, axis=1)
    return out & ~own


def _sufficient(local: list[np.ndarray], asked: _Asked, a: int, b: int) -> np.ndarray:
    """Which entries reach the uniform threshold, the cutoff over the number of slices, in a slice. The
    threshold is rounded down, so that it is safe."""
    scores = asked.scores[a:b, None]
    least = np.floor_divide(scores, len(local))
    return reduce(np.logical_or, (part >= least for part in local), scores == -LONG - 1)


def _total(local: list[np.ndarray], q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The scores of the entries (q, r), all slices added."""
    kind = object if local[0].dtype == object else np.int64
    return to_long(sum(part[q, r].astype(kind) for part in local)) if len(q) else np.zeros(0, np.int64)


def _task(asked: _Asked, p: TopK, gather: bool):
    n = len(asked.at)

    def entries(x: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a in range(0, n, p.block):
            b = min(n, a + p.block)
            local = _local(x, asked.vectors[a:b], p.lists)
            own = asked.at[a:b, None] == keys[None, :]
            if gather:
                q, r = np.nonzero(_named(local, own, p.k))
            else:
                q, r = np.nonzero(_sufficient(local, asked, a, b) & ~own)
            score, at = _total(local, q, r), q + a
            above = (score > asked.scores[at]) | ((score == asked.scores[at]) & (keys[r] <= asked.keys[at]))
            yield at[above], r[above], score[above]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, p.block):
                b = batch.slice(at, p.block)
                x, keys = matrix(b.column("x"), asked.vectors.shape[1]), b.column("key").fill_null(LONG).to_numpy(zero_copy_only=False)
                for q, r, score in entries(x, keys):
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), b.column("key").take(pa.array(r)), pa.array(score)], names=["q", "key", "score"])

    return run


#: An entry: the place of its query in the group, its key and its score.
ENTRY = "q int, key long, score long"


def _cutoffs(asked: _Asked, best: DataFrame, k: int) -> _Asked:
    """The queries with the k-th best of ``best`` as their cutoffs; a row for each query of a group."""
    last = best.filter(F.col("rank") == k).select("q", F.coalesce("key", F.lit(LONG)).alias("key"), "score").toArrow()
    scores, keys, q = asked.scores.copy(), asked.keys.copy(), last["q"].to_numpy()
    scores[q], keys[q] = last["score"].to_numpy(), last["key"].to_numpy()
    return _Asked(asked.at, asked.vectors, scores, keys)


def _ranked(entries: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("q").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return entries.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _rounds(n: int, p: TopK) -> list[float]:
    """Shares of the rows: of the first phase, then up to the end of each round."""
    steps = max(1, math.ceil(math.log(max(1, n / p.first), p.growth)))
    return [float(p.growth) ** -i for i in range(steps, -1, -1)]


def search(df: DataFrame, asks: Column, vector: str = "embedding", key: str = "vec_id", p: TopK | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``df`` where ``asks`` holds, its ``k`` best rows."""
    p = p or TopK()
    spark = df.sparkSession
    place = F.pmod(F.xxhash64(df[key].cast("long"), F.lit("round")), F.lit(1 << 30)) / float(1 << 30)
    rows = df.select(df[key].cast("long").alias("key"), scaled(df, vector, p.scale).alias("x"), asks.alias("asks"), place.alias("place")).filter("x IS NOT NULL")
    queries = rows.filter("asks AND key IS NOT NULL").select("key", "x").distinct()
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    count = queries.count()
    found = [spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")]
    shares = _rounds(n, p)
    for group in _groups(queries, count, p):
        held = group.toArrow()
        at, xs = held["key"].to_numpy(), matrix(held["x"], dims)
        asked = _Asked(at, xs, np.full(len(at), -LONG - 1), np.full(len(at), LONG))
        few = rows.filter(F.col("place") < shares[0]).select("key", "x").repartition(1 + int(n * shares[0]) // (4 * p.first))
        asked = _cutoffs(asked, _ranked(few.mapInArrow(_task(asked, p, gather=True), ENTRY), p.k), p.k)
        best = None
        for a, b in itertools.pairwise([0.0, *shares[1:]]):
            part = rows.filter((F.col("place") >= a) & (F.col("place") < b)).select("key", "x")
            got = part.mapInArrow(_task(asked, p, gather=False), ENTRY)
            best = _ranked(got if best is None else got.unionByName(best.drop("rank")), p.k)
            if b < 1:
                best = cut(best)
                asked = _cutoffs(asked, best, p.k)
        names = spark.createDataFrame(pa.table({"q": np.arange(len(at), dtype=np.int32), "query_id": asked.at}))
        found.append(best.join(F.broadcast(names), "q").select("query_id", "rank", F.col("key").alias("vec_id"), "score"))
    return reduce(DataFrame.unionByName, found)


def _groups(queries: DataFrame, count: int, p: TopK) -> Iterator[DataFrame]:
    """The queries in groups of at most ``p.group``, as counted: dealt by hash, in more parts where one
    is too large."""
    if count <= p.group:
        return iter([queries] if count else [])
    parts = math.ceil(1.2 * count / p.group)
    while True:
        of = F.pmod(F.xxhash64("key", "x", F.lit("group")), F.lit(parts))
        if queries.groupBy(of.alias("g")).count().agg(F.max("count")).first()[0] <= p.group:
            return (queries.filter(of == g) for g in range(parts))
        parts *= 2
