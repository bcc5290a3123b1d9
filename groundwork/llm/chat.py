"""Preference formatting of conversations, in DataFrame functions only.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns is rendered
once as the prompt; the turns after it are rendered as two completions, each with the character
spans that a loss covers (the assistant's words and their end mark).

Edge cases: turns stand by (turn, role, text), so ties and repeated rows have one order; a null
role is "unknown" and a null text is empty; a side without turns after the prefix has an empty
completion without spans; rows without a conv_id give no pair; a pair that lacks a side is dropped by ``format_pairs``; an empty table
gives an empty table; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MID, END = "<|", "|>\n", "<|end|>\n"


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns, an array of (turn, role, text) in order. Rows without a conv_id are of
    no conversation."""
    t = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(t)).alias("turns"))


def _half(text: Column) -> Column:
    """The first half of a text's words."""
    ws = F.split(text, " ")
    return F.array_join(F.slice(ws, 1, F.floor(F.size(ws) / 2).cast("int")), " ")


def stale_reply_pairs(conversations: DataFrame, early: Column | None = None) -> DataFrame:
    """Pairs from plain conversations: the chosen side is the conversation up to its last assistant
    turn; the rejected side ends with a worse reply to the same turns: the assistant's previous
    reply, or, where there is none, the first half of the words of the same reply. Where ``early``
    holds, the rejected side leaves at the first reply, of which it has the first half, and goes on with
    the same turns. Conversations without an assistant turn give no pair."""
    c = conversation_turns(conversations)
    said = F.filter("turns", lambda t: t["role"] == "assistant")
    c = c.withColumn("_said", said).filter(F.size("_said") > 0)
    c = c.withColumn("_last", F.element_at("_said", -1)).withColumn("_upto", F.filter("turns", lambda t: t <= F.col("_last")))
    stale = F.when(F.size("_said") > 1, F.get("_said", F.size("_said") - 2)["text"]).otherwise(_half(F.col("_last.text")))
    worse = F.struct(F.col("_last.turn").alias("turn"), F.col("_last.role").alias("role"), stale.alias("text"))
    rejected = F.concat(F.slice("_upto", 1, F.size("_upto") - 1), F.array(worse))
    if early is not None:
        at = F.array_position(F.transform("_upto", lambda t: t["role"] == "assistant"), F.lit(True)) - 1
        left = F.transform("_upto", lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i == at, _half(t["text"])).otherwise(t["text"]).alias("text")))
        rejected = F.when(early, left).otherwise(rejected)
    return c.select(F.col("conv_id").alias("pair_id"), F.col("_upto").alias("chosen_turns"), rejected.alias("rejected_turns"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(MID))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """Half-open spans, in code points of the rendered turns, of what the assistant says."""
    start = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a, t):
        begin = a["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + len(END)
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(a["spans"], one)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda a: a["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, chosen_turns, rejected_turns) to pair_id, n_prefix, prompt, chosen, rejected,
    chosen_spans, rejected_spans. One row in, one row out, no shuffle."""
    a, b = F.col("chosen_turns"), F.col("rejected_turns")
    p = pairs.filter(a.isNotNull() & b.isNotNull())
    same = lambda i: (F.get(a, i)["role"] == F.get(b, i)["role"]) & (F.get(a, i)["text"] == F.get(b, i)["text"])
    shorter = F.least(F.size(a), F.size(b))
    each = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.expr("array()").cast("array<int>"))
    first = F.array_position(F.transform(each, same), F.lit(False)).cast("int")
    p = p.withColumn("n_prefix", F.when(first > 0, first - 1).otherwise(shorter))
    rest = lambda x: F.slice(x, F.col("n_prefix") + 1, F.greatest(F.size(x) - F.col("n_prefix"), F.lit(0)))
    p = p.withColumn("_a", rest(a)).withColumn("_b", rest(b))
    return p.select(
        "pair_id", F.col("n_prefix").cast("long").alias("n_prefix"), render(F.slice(a, 1, F.col("n_prefix"))).alias("prompt"),
        render(F.col("_a")).alias("chosen"), render(F.col("_b")).alias("rejected"),
        loss_spans(F.col("_a")).alias("chosen_spans"), loss_spans(F.col("_b")).alias("rejected_spans"),
    )


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
