"""BagMinHash signatures of multisets, for many documents at once.

A shingle x with weight w (how often the document has it) owns the interval [0, w). The line is cut
into dyadic blocks [0, 1), [1, 2), [2, 4), [4, 8), ...; each block of each shingle has one Poisson
process of the block's length, drawn from a hash of (x, block), so that all documents see the same
points. A document takes the points inside [0, w): all of a full block, and of the last block those
whose position, drawn with the point, is below w. Each point falls on one of m components; a
component keeps its earliest point. Two documents agree on a component with a probability equal to
their weighted Jaccard similarity. Points are drawn up to a time by which all components have one
almost surely; documents with an empty component go on to a later time.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + _A
    x = (x ^ (x >> U(30))) * _B
    x = (x ^ (x >> U(27))) * _C
    return x ^ (x >> U(31))


def shingles(words: np.ndarray, starts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every k-word shingle. ``words``: hashes of all documents' words in turn;
    ``starts``: n + 1 offsets. A document of fewer words has one shingle of all its words."""
    n = np.diff(starts)
    last = np.repeat(starts[1:], n)
    own = np.repeat(np.arange(len(n)), n)
    size = np.minimum(np.repeat(n, n), k)
    at = np.flatnonzero(np.arange(len(words)) + size <= last)
    at = at[(n[own[at]] >= k) | (at == starts[own[at]])]
    h = np.full(len(at), U(k))
    room = size[at]
    for j in range(k):
        has = j < room
        h[has] = mixed(h[has] ^ words[at[has] + j])
    return h, own[at]


def weighted(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, document, weight), one row for each shingle of a document."""
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    return h[at], own[at], np.diff(np.append(at, len(h)))


def signatures(words: np.ndarray, starts: np.ndarray, m: int = 128, k: int = 5) -> np.ndarray:
    """An array (documents, m) of 64-bit ids of the earliest points; rows of documents without
    words are 0."""
    docs = len(starts) - 1
    x, own, w = weighted(*shingles(words, starts, k))
    sig = np.zeros((docs, m), U)
    total = np.bincount(own, w, docs)
    until = m * (np.log(m) + 4) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        done = _fill(x, own, w, until, todo, sig, m)
        todo &= ~done
        until *= 2
    return sig


def _fill(x, own, w, until, todo, sig, m) -> np.ndarray:
    use = todo[own]
    x, own, w = x[use], own[use], w[use]
    keys, times, ids = [], [], []
    k = 0
    while len(x):
        low, high = (0, 1) if k == 0 else (1 << (k - 1), 1 << k)
        rate = high - low
        seed = mixed(x ^ mixed(np.full(1, k, U)))
        t, doc, weight, j = np.zeros(len(x)), own, w, 0
        while len(seed):
            seed = mixed(seed + U(j + 1))
            t = t - np.log(((seed >> U(11)).astype(float) + 0.5) / 9007199254740992.0) / rate
            live = t <= until[doc]
            seed, t, doc, weight = seed[live], t[live], doc[live], weight[live]
            point = mixed(seed ^ _B)
            if rate > 1:
                inside = low + ((point >> U(20)) % U(rate)).astype(np.int64) < weight
                keys.append((doc * m + (point % U(m)).astype(np.int64))[inside])
                times.append(t[inside])
                ids.append(point[inside])
            else:
                keys.append(doc * m + (point % U(m)).astype(np.int64))
                times.append(t)
                ids.append(point)
            j += 1
        more = w > high
        x, own, w, k = x[more], own[more], w[more], k + 1
    key, time, point = np.concatenate(keys), np.concatenate(times), np.concatenate(ids)
    first = np.full(sig.size, np.inf)
    np.minimum.at(first, key, time)
    best = time == first[key]
    done = np.isfinite(first).reshape(sig.shape).all(axis=1)
    flat, hit = sig.reshape(-1), done[key // m] & best
    flat[key[hit]] = point[hit]
    return done


def bands(sig: np.ndarray, rows: int = 4) -> np.ndarray:
    """(documents, m / rows) bucket hashes; a bucket of one band never equals one of another."""
    parts = sig.reshape(len(sig), -1, rows)
    h = np.broadcast_to(np.arange(parts.shape[1], dtype=U), parts.shape[:2]).copy()
    for r in range(rows):
        h = mixed(h ^ parts[:, :, r])
    return h
