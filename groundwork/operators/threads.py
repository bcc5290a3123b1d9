"""Threads and translation units: messages, ancestors, batches."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.operators.latest import carried
from groundwork.plans.lineage import checkpointed


def assemble_thread_input(messages: DataFrame, thread: str, order: str, text: str = "text") -> DataFrame:
    """thread, n, input: messages in order, the later ones marked as follow-ups."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    by = messages.groupBy(thread).agg(items.alias("items"))
    parts = F.transform("items", lambda x, i: F.when(i == 0, x["t"]).otherwise(F.concat(F.lit("[follow-up] "), x["t"])))
    return by.select(thread, F.size("items").cast("long").alias("n"), F.array_join(parts, "\n\n").alias("input"))


def last_directive(messages: DataFrame, thread: str, order: str, rules: dict[str, str], text: str = "text") -> DataFrame:
    """thread and, for each rule (column, pattern with one group), the value of the last message that
    has it; later messages without it leave it."""
    value = lambda p: F.nullif(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), p, 1), F.lit(""))
    last = [F.max_by(value(p), F.when(value(p).isNotNull(), F.col(order))).alias(name) for name, p in rules.items()]
    return messages.groupBy(thread).agg(*last)


def nearest_ancestor(runs: DataFrame, artifacts: DataFrame, most: int | None = None) -> DataFrame:
    """(id, ancestor, depth): the nearest ancestor within the same thread that has an artifact, at
    any depth, or at ``most`` of them where given. Rows that still look take over where the row that
    they have come to points, so that each round doubles their way; a way as long as the runs of the
    longest thread is a cycle without an artifact and ends. A run is no ancestor of its own."""
    has = artifacts.select(F.col("id").alias("at"), F.lit(True).alias("hit")).distinct()
    up = runs.select(F.col("id").alias("at"), "thread_key")
    first = runs.select("id", F.col("parent_id").alias("at"), "thread_key", F.lit(1).alias("depth")).filter("at is not null")
    ways = checkpointed(first.join(up, ["at", "thread_key"]).join(has, "at", "left").select("id", "thread_key", "at", "depth", F.coalesce("hit", F.lit(False)).alias("hit")))
    if most is None:
        most = runs.groupBy("thread_key").count().agg(F.max("count")).first()[0] or 0
    found = [ways.filter("hit")]
    looking = ways.filter(f"not hit and depth < {most}")
    while looking.take(1):
        on = ways.select(F.col("id").alias("at"), "thread_key", F.col("at").alias("to"), F.col("depth").alias("more"), "hit")
        moved = looking.drop("hit").join(on, ["at", "thread_key"]).select("id", "thread_key", F.col("to").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), "hit")
        moved = checkpointed(moved)
        found.append(moved.filter("hit"))
        looking = moved.filter(f"not hit and depth < {most}")
        ways = reduce(DataFrame.unionByName, [*found, looking])
    return reduce(DataFrame.unionByName, found).filter(f"depth <= {most} and id <> at").select("id", F.col("at").alias("ancestor"), "depth")


def pack_batches(units: DataFrame, doc: str, order: str, chars: int = 8000, items: int = 24) -> DataFrame:
    """units with batch (from 1): greedy packing in order by characters and items; a unit beyond
    the limit is a batch of its own. Documents are streamed in order, a bounded batch of units at a time."""
    rows = units.select(doc, order, F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))

    def start() -> tuple[int, int, int]:
        return 1, 0, 0

    def step(now: tuple[int, int, int], n: int) -> tuple[tuple[int, int, int], tuple]:
        batch, used, held = now
        if held and (used + n > chars or held >= items):
            batch, used, held = batch + 1, 0, 0
        return (batch, used + n, held + 1), (batch,)

    return carried(rows, [doc], [F.col(order).asc_nulls_last(), F.col("size")], "size", start, step, "batch long")


#: What a cut must not go through in texts whose links and formulas are placeholders.
PLACEHOLDERS = r"\[[^\[\]\n]+\]\(⟦[^⟦⟧\n]+⟧\)|⟦[^⟦⟧\n]+⟧"
#: What a cut must not go through in other texts: links and formulas as well.
PROTECTED = r"\[[^\[\]\n]+\]\([^()\s]+\)|⟦[^⟦⟧\n]+⟧|\$\$[^$]+\$\$|\$[^\s$][^$\n]*\$"


def _cuts(t: str, limit: int, spans: list[tuple[int, int]]) -> list[str]:
    """``t`` in parts; ``spans`` in order, none of which is cut, are passed once."""
    out, at, i = [], 0, 0
    while len(t) - at > limit:
        end = max(t.rfind("\n", at + limit // 2, at + limit), t.rfind(" ", at + limit // 2, at + limit))
        end = end + 1 if end >= 0 else at + limit
        while i < len(spans) and spans[i][1] <= end:
            i += 1
        if i < len(spans) and spans[i][0] < end:
            end = spans[i][0] if spans[i][0] > at else spans[i][1]
        out.append(t[at:end])
        at = end
    return [*out, t[at:]] if at < len(t) or not out else out


def chunk_text(units: DataFrame, keys: Sequence[str], limit: int, text: str = "text", protected: str = PLACEHOLDERS) -> DataFrame:
    """keys, n, part: a text cut into parts of at most ``limit`` characters, each at the last blank
    or line break past half of the limit, else at the limit. A cut that would go through what
    ``protected`` matches is made before it; what is longer than the limit is a part of its own length.
    The parts joined are the text."""

    @F.pandas_udf("array<string>")
    def parts(col: pd.Series) -> pd.Series:
        keep = re.compile(protected)
        return pd.Series([_cuts(x or "", limit, [m.span() for m in keep.finditer(x or "")]) for x in col])

    return units.select(*keys, F.posexplode(parts(F.col(text))).alias("n", "part")).withColumn("n", F.col("n") + 1)
