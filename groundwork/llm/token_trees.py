"""Segment trees of token counts over the pre-tokens of a text, and their update under edits.

A text is cut into leaves at places where the pre-tokenizer cuts whatever stands around: before a
space with a word character on its right and no white space on its left. No merge of the byte-pair
encoder crosses a pre-token, so the counts of the leaves add up to the count of the text. The tree
keeps the leaves' lengths and the sums of counts of all their dyadic ranges.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

#: A place where a pre-token begins for certain.
_SAFE = re.compile(r"(?<=[^\s])(?= [^\W_])")


@dataclass
class Tree:
    """lengths: code points of each leaf. sums: the root's count at 1, the children of i at 2 i and
    2 i + 1, the leaves from ``size`` on (a power of two)."""

    lengths: list[int]
    sums: list[int]

    @property
    def size(self) -> int:
        return len(self.sums) // 2

    @property
    def total(self) -> int:
        return self.sums[1]


def leaves(text: str, around: int) -> list[str]:
    """The text in pieces of about ``around`` code points, cut at safe places."""
    out, start, n = [], 0, len(text)
    while n - start > around:
        m = _SAFE.search(text, start + around)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]] if start < n or not out else out


def build(text: str, count: Callable[[str], int], around: int) -> Tree:
    parts = leaves(text, around)
    return _over([len(x) for x in parts], [count(x) for x in parts])


def _over(lengths: list[int], counts: list[int]) -> Tree:
    size = 1
    while size < len(counts):
        size *= 2
    sums = [0] * size + counts + [0] * (size - len(counts))
    for i in range(size - 1, 0, -1):
        sums[i] = sums[2 * i] + sums[2 * i + 1]
    return Tree(lengths, sums)


def edit(tree: Tree, text: str, edits: Sequence[tuple[int, int, str]], count: Callable[[str], int], around: int) -> tuple[Tree, str, int]:
    """The tree and the text after ``edits`` (start, end, new; sorted, apart), and how many code
    points were encoded again: those of the leaves that edits touch and of one leaf on either side,
    within which the places of cuts may move. Where the number of leaves stays, only sums above
    touched leaves are set again; else the sums are laid out anew, without encoding."""
    starts, at = [], 0
    for n in tree.lengths:
        starts.append(at)
        at += n
    total = at
    groups: list[list] = []  # [first leaf, last leaf, edits]
    leaf = 0
    for e in edits:
        while leaf + 1 < len(starts) and starts[leaf + 1] <= e[0]:
            leaf += 1
        last = leaf
        while last + 1 < len(starts) and starts[last + 1] < e[1]:
            last += 1
        first, last = max(0, leaf - 1), min(len(starts) - 1, last + 1)
        if groups and first <= groups[-1][1] + 1:
            groups[-1][1] = max(groups[-1][1], last)
            groups[-1][2].append(e)
        else:
            groups.append([first, last, [e]])
    lengths, counts, out = [], [], []
    own = tree.sums[tree.size : tree.size + len(tree.lengths)]
    encoded, kept, moved = 0, 0, []
    for first, last, es in groups:
        lengths += tree.lengths[kept:first]
        counts += own[kept:first]
        begin, end = starts[first], starts[last] + tree.lengths[last]
        out.append(text[starts[kept] if kept < len(starts) else total : begin])
        piece, p = [], begin
        for a, b, new in es:
            piece += [text[p:a], new]
            p = b
        new_text = "".join([*piece, text[p:end]])
        parts = leaves(new_text, around) if new_text else []
        moved.append((len(counts), len(parts), last + 1 - first))
        lengths += [len(x) for x in parts]
        counts += [count(x) for x in parts]
        encoded += len(new_text)
        out.append(new_text)
        kept = last + 1
    lengths += tree.lengths[kept:]
    counts += own[kept:]
    if kept < len(starts):
        out.append(text[starts[kept] :])
    if all(new == old for _, new, old in moved):
        sums = list(tree.sums)
        dirty = set()
        for place, new, _ in moved:
            for i in range(place, place + new):
                sums[tree.size + i] = counts[i]
                dirty.add((tree.size + i) // 2)
        while dirty and 0 not in dirty:
            for i in dirty:
                sums[i] = sums[2 * i] + sums[2 * i + 1]
            dirty = {i // 2 for i in dirty if i > 1}
        return Tree(lengths, sums), "".join(out), encoded
    return _over(lengths or [0], counts or [0]), "".join(out), encoded
