"""Benchmark decontamination by greedy string tiling.

Seeds are runs of five words that a document shares with a benchmark item. A document and an item
whose shared seeds could cover enough of the item are tiled: the longest common runs of words are
marked, without overlap, by running Karp-Rabin, and the item counts as leaked where the tiles cover
the threshold's share of its words, in whatever order the passages stand.

A benchmark up to ``broadcast_chars`` goes to every executor, so that documents are neither shuffled
nor joined; a larger one meets the documents' seeds in a shuffle join. Both give the same pairs.

Edge cases: null texts are empty; items of fewer than five words are no evidence and are skipped;
repeated rows are judged each; rows without a doc_id are judged too; equal item_ids with other texts
are items of their own and give a row each; empty tables give empty results; further columns pass
through ``drop_contaminated`` and are not read by ``contaminated``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.llm.lineage import cut
from groundwork.llm.text import TERM, whole
from groundwork.llm.tiling import tiles


@dataclass(frozen=True)
class Leak:
    """seed: words of a seed and least length of a tile. coverage: share of an item's words that
    makes a leak. broadcast_chars: characters of a benchmark that is still sent to all executors."""

    seed: int = 5
    coverage: float = 0.5
    broadcast_chars: int = 8_000_000


PAIRS = "doc_id long, item_id long, coverage double, longest long, n_tiles long"
_TERMS = re.compile(TERM)


def terms(text: str) -> list[str]:
    return _TERMS.findall(text.lower())


def _measure(item: list, doc: list, p: Leak) -> tuple[float, int, int]:
    found = tiles(item, doc, p.seed)
    return sum(n for _, _, n in found) / len(item), max((n for _, _, n in found), default=0), len(found)


class Index:
    """Seeds of all items, for one executor: sorted hashes of five word numbers, and the (item,
    place) of each."""

    def __init__(self, items: list[tuple[int, str]], p: Leak):
        self.p, self.ids, self.items, self.vocabulary = p, [], [], {}
        hashes, owner, place = [], [], []
        for item_id, text in items:
            ws = terms(text)
            if len(ws) < p.seed:
                continue
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws], np.int64)
            h = self._rolled(numbers)
            hashes.append(h)
            owner.append(np.full(len(h), len(self.ids)))
            place.append(np.arange(len(h)))
            self.ids.append(item_id)
            self.items.append(numbers.tolist())
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner = np.concatenate(owner)[order] if hashes else h
        self.place = np.concatenate(place)[order] if hashes else h

    def _rolled(self, numbers: np.ndarray) -> np.ndarray:
        k = self.p.seed
        h = np.zeros(max(0, len(numbers) - k + 1), np.int64)
        with np.errstate(over="ignore"):
            for j in range(k):
                h = (h ^ (h >> 29)) * 6364136223846793005 + numbers[j : j + len(h)] + 1
        return h

    def leaks(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item_id, coverage, longest, n_tiles) of every item that the text leaks."""
        k, known = self.p.seed, self.vocabulary
        ws = terms(text)
        if len(ws) < k or not len(self.hashes):
            return []
        numbers = np.array([known.get(w, -1) for w in ws], np.int64)
        bad = np.concatenate(([0], np.cumsum(numbers < 0)))
        at = np.flatnonzero(bad[k:] == bad[:-k])
        h = self._rolled(numbers)[at]
        low = np.searchsorted(self.hashes, h)
        low[low == len(self.hashes)] = 0
        hit = self.hashes[low] == h
        if not hit.any():
            return []
        at, low = at[hit], low[hit]
        n = np.searchsorted(self.hashes, h[hit], "right") - low
        rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        where = np.repeat(at, n)
        out = []
        order = np.argsort(self.owner[rows], kind="stable")
        rows, where = rows[order], where[order]
        cuts = np.flatnonzero(np.diff(self.owner[rows])) + 1
        for r, spots in zip(np.split(rows, cuts), np.split(where, cuts), strict=True):
            i = int(self.owner[r[0]])
            item = self.items[i]
            covered = np.zeros(len(item), bool)
            for j in range(k):
                covered[self.place[r] + j] = True
            if covered.sum() < self.p.coverage * len(item):
                continue
            spots = np.unique(spots)
            part: list[int] = []  # only words under shared seeds can lie in a tile
            end = -1
            for s in spots.tolist():
                if s > end:
                    part.append(-1)
                part.extend(numbers[max(s, end) : s + k].tolist())
                end = s + k
            share, longest, count = _measure(item, part, self.p)
            if share >= self.p.coverage:
                out.append((self.ids[i], share, longest, count))
        return out


def _is_small(benchmark: DataFrame, p: Leak) -> bool:
    return (benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) <= p.broadcast_chars


def _shared(benchmark: DataFrame, p: Leak):
    """The benchmark, whose size has been checked, on every executor."""
    items = [(r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("long"), whole("text")).collect()]
    return benchmark.sparkSession.sparkContext.broadcast(sorted(items, key=lambda x: (x[0] is None, x[0], x[1])))


_CACHE: dict = {}


def _index(shared, p: Leak) -> Index:
    """One index for each Python worker and benchmark."""
    if (shared.id, p) not in _CACHE:
        _CACHE.clear()
        _CACHE[shared.id, p] = Index(shared.value, p)
    return _CACHE[shared.id, p]


class _Shared:
    def __init__(self, broadcast):
        self.broadcast = broadcast
        self.id = str(broadcast._jbroadcast.id())

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Leak | None = None) -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, coverage, longest, n_tiles."""
    p = p or Leak()
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole("text").alias("text"))
    if not _is_small(benchmark, p):
        return _by_shuffle(cut(d.withColumn("row", F.monotonically_increasing_id())), benchmark, p).drop("row")
    shared = _Shared(_shared(benchmark, p))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _index(shared, p)
        for f in frames:
            rows = [(i, *leak) for i, x in zip(f["doc_id"], f["text"], strict=True) for leak in index.leaks(x)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "coverage", "longest", "n_tiles"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return d.mapInPandas(run, PAIRS)


def _seeds(p: Leak, id_: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, x in zip(f[id_], f["text"], strict=True):
                ws = terms(x)
                n = len(ws) - p.seed + 1
                if n > 0:
                    h = [int.from_bytes(hashlib.blake2b(" ".join(ws[j : j + p.seed]).encode(), digest_size=8).digest(), "big", signed=True) for j in range(n)]
                    yield pd.DataFrame({id_: i, "h": h, "place": range(n), "n": len(ws)})

    return run


def _by_shuffle(d: DataFrame, benchmark: DataFrame, p: Leak) -> DataFrame:
    """The pairs, with the row of ``d`` (row, doc_id, text), whose numbers have to be fixed."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole("text").alias("text"))
    items = cut(items.withColumn("item", F.monotonically_increasing_id()))
    own = items.select("item", "text").mapInPandas(_seeds(p, "item"), "item long, h long, place long, n long")
    seeds = d.select("row", "text").mapInPandas(_seeds(p, "row"), "row long, h long, place long, n long").select("row", "h").distinct()
    enough = F.countDistinct("place") * p.seed >= p.coverage * F.max("n")
    pairs = seeds.join(own, "h").groupBy("row", "item").agg(enough.alias("ok")).filter("ok").select("row", "item")
    texts = pairs.join(items.withColumnRenamed("text", "item_text"), "item").join(d, "row")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for row, i, item_id, item, text in zip(f["row"], f["doc_id"], f["item_id"], f["item_text"], f["text"], strict=True):
                numbers: dict[str, int] = {}
                a = [numbers.setdefault(w, len(numbers)) for w in terms(item)]
                share, longest, count = _measure(a, [numbers.get(w, -1) for w in terms(text)], p)
                if share >= p.coverage:
                    rows.append((row, i, item_id, share, longest, count))
            yield pd.DataFrame(rows, columns=["row", "doc_id", "item_id", "coverage", "longest", "n_tiles"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return texts.select("row", "doc_id", "item_id", "item_text", "text").mapInPandas(run, f"row long, {PAIRS}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, p: Leak | None = None) -> DataFrame:
    """The documents that leak no item, in the columns of ``docs``."""
    p = p or Leak()
    if not _is_small(benchmark, p):
        number = "_row" + "_" * max(map(len, docs.columns))  # no column has this name
        kept = cut(docs.withColumn(number, F.monotonically_increasing_id()))
        rows = kept.select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
        gone = _by_shuffle(rows, benchmark, p).select(F.col("row").alias("_gone")).distinct()
        return kept.join(gone, kept[number] == gone["_gone"], "left_anti").select(*docs.columns)
    shared = _Shared(_shared(benchmark, p))

    @F.pandas_udf(T.BooleanType())
    def clean(text: pd.Series) -> pd.Series:
        index = _index(shared, p)
        return pd.Series([not index.leaks(x) for x in text], dtype=bool)

    return docs.filter(clean(whole("text")))
