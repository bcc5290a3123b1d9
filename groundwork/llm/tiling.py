"""Greedy string tiling of two token sequences with running Karp-Rabin hashes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

_BASE, _MOD = 1_000_003, (1 << 61) - 1


def _windows(seq: Sequence[int], free: list[bool], s: int):
    """(start, hash) of every window of ``s`` unmarked tokens; the hash runs along the sequence."""
    high = pow(_BASE, s - 1, _MOD)
    h = run = 0
    for i, x in enumerate(seq):
        if not free[i]:
            h = run = 0
            continue
        if run >= s:
            h = (h - (seq[i - s] + 2) * high) % _MOD
        h = (h * _BASE + x + 2) % _MOD
        run += 1
        if run >= s:
            yield i - s + 1, h


def _matches(p: Sequence[int], t: Sequence[int], free_p: list[bool], free_t: list[bool], s: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, start in p, start in t) of at least ``s`` unmarked tokens."""
    at = defaultdict(list)
    for i, h in _windows(p, free_p, s):
        at[h].append(i)
    out, seen = [], {}
    for j, h in _windows(t, free_t, s):
        for i in at.get(h, ()):
            if seen.get(i - j, -1) >= j:  # inside a match that is listed
                continue
            n = 0
            while i + n < len(p) and j + n < len(t) and free_p[i + n] and free_t[j + n] and p[i + n] == t[j + n]:
                n += 1
            if n >= s:
                out.append((n, i, j))
                seen[i - j] = j + n - s
    return out


def tiles(p: Sequence[int], t: Sequence[int], shortest: int) -> list[tuple[int, int, int]]:
    """Tiles (start in p, start in t, length), longest first: the longest matches that overlap no
    earlier tile, marked again and again down to ``shortest`` tokens."""
    free_p, free_t = [True] * len(p), [x >= 0 for x in t]
    out: list[tuple[int, int, int]] = []
    s = max(shortest, min(32, len(p)))
    while True:
        queue = sorted(_matches(p, t, free_p, free_t, s), key=lambda m: (-m[0], m[1], m[2]))
        if queue and queue[0][0] > 2 * s:
            s = queue[0][0]
            continue
        again = False
        while queue:
            n, i, j = queue.pop(0)
            if all(free_p[i : i + n]) and all(free_t[j : j + n]):
                free_p[i : i + n] = free_t[j : j + n] = [False] * n
                out.append((i, j, n))
            else:  # what a tile has cut off is found again
                again = True
        if again:
            continue
        if s == shortest:
            return out
        s = max(shortest, s // 2)
