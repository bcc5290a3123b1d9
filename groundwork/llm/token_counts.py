"""Edit-aware token counts.

``build`` gives each document its segment tree of token counts; ``recount`` applies edits to
documents with trees and encodes only what the edits touch plus its boundary context, so that a
revision of a corpus costs what has changed. The vocabulary is a file of a public byte-level BPE
tokenizer; its path is a parameter and the file is read where the tasks run.

``clean_up_edits`` is the revision that the registered query counts: it masks e-mail addresses and
runs of 12 or more digits and collapses runs of blanks, marks and line breaks.

Edge cases: a null text is empty and has one empty leaf and no tokens; a document without edits keeps
its tree; edits that overlap an earlier one or leave the text are left out; repeated rows are counted
each; an empty table gives an empty table; further columns of ``docs`` are not read.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.text import whole
from groundwork.llm.token_trees import Tree, build, edit

# fixed value: the pre-tokenizer's pattern of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Vocabulary:
    """path: a file of ranks (base64 token, rank). leaf: code points of a leaf, about."""

    path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    leaf: int = 256


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counter(path: str):
    encode = encoding(path).encode_ordinary
    return lambda text: len(encode(text))


TREES = "doc_id long, text string, lengths array<int>, sums array<int>"
EDITS = "array<struct<start:int,end:int,new:string>>"
_RUNS = re.compile(r"[0-9]{12,}|[ \t]{2,}|\n{2,}|[*$%&#!]{2,}")
_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]{3,255}")


def build_trees(docs: DataFrame, v: Vocabulary | None = None) -> DataFrame:
    """doc_id, text, lengths, sums: each document with its tree. One scan, no shuffle."""
    v = v or Vocabulary()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(v.path)
        for f in frames:
            made = [build(x, count, v.leaf) for x in f["text"]]
            yield f.assign(lengths=[t.lengths for t in made], sums=[t.sums for t in made])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole("text").alias("text")).mapInPandas(run, TREES)


def clean_up_edits(text: str) -> list[tuple[int, int, str]]:
    mails = [(*m.span(), "[mail]") for m in _MAIL.finditer(text)] if "@" in text else []
    runs = [(*m.span(), "[number]" if m[0][0].isdigit() else m[0][0]) for m in _RUNS.finditer(text)]
    return sorted(mails + [r for r in runs if not any(m[0] < r[1] and r[0] < m[1] for m in mails)])


def _sound(edits: Sequence, size: int) -> list[tuple[int, int, str]]:
    out, at = [], 0
    for a, b, new in sorted((int(e["start"]), int(e["end"]), e["new"] or "") for e in edits):
        if at <= a <= b <= size:
            out.append((a, b, new))
            at = b
    return out


def recount(trees: DataFrame, v: Vocabulary | None = None) -> DataFrame:
    """``trees`` with a column edits (start, end, new) to doc_id, text, lengths, sums after the edits,
    n_before, n_after and n_encoded (code points encoded again)."""
    v = v or Vocabulary()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(v.path)
        for f in frames:
            rows = []
            for i, text, lengths, sums, edits in zip(f["doc_id"], f["text"], f["lengths"], f["sums"], f["edits"], strict=True):
                old = Tree(list(map(int, lengths)), list(map(int, sums)))
                es = _sound(edits if edits is not None else [], len(text))
                new, out, n = edit(old, text, es, count, v.leaf) if es else (old, text, 0)
                rows.append((i, out, new.lengths, new.sums, old.total, new.total, n))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "lengths", "sums", "n_before", "n_after", "n_encoded"]).astype({"doc_id": f["doc_id"].dtype})

    return trees.select("doc_id", "text", "lengths", "sums", "edits").mapInPandas(run, f"{TREES}, n_before long, n_after long, n_encoded long")


def revised_counts(docs: DataFrame, v: Vocabulary | None = None, rows: int = 500) -> DataFrame:
    """What ``recount`` gives for every document under its clean-up. Tree, edits and update are one
    pass over a text, ``rows`` documents at a time, so that a task holds one vocabulary."""
    v = v or Vocabulary()
    names = ["doc_id", "text", "lengths", "sums", "n_before", "n_after", "n_encoded"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(v.path)
        for f in frames:
            for at in range(0, len(f), rows):
                part = f.iloc[at : at + rows]
                out = []
                for i, text in zip(part["doc_id"], part["text"], strict=True):
                    old = build(text, count, v.leaf)
                    es = clean_up_edits(text)
                    new, changed, n = edit(old, text, es, count, v.leaf) if es else (old, text, 0)
                    out.append((i, changed, new.lengths, new.sums, old.total, new.total, n))
                yield pd.DataFrame(out, columns=names).astype({"doc_id": f["doc_id"].dtype})

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole("text").alias("text"))
    return d.mapInPandas(run, f"{TREES}, n_before long, n_after long, n_encoded long")
