"""A small linear-chain conditional random field over binary features: training and Viterbi.

A sequence is a list of positions, a position a list of feature numbers. Weights are trained by
gradient steps (AdaGrad) on the log-likelihood with forward-backward, on the driver, from a bounded
labelled sample; they are a few hundred numbers and travel with the task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Crf:
    """emit: (features, labels); step: (labels, labels) from, to; begin: labels."""

    emit: np.ndarray
    step: np.ndarray
    begin: np.ndarray

    def scores(self, seq: Sequence[Sequence[int]]) -> np.ndarray:
        n = np.fromiter(map(len, seq), np.int64, len(seq))
        flat = np.fromiter((f for fs in seq for f in fs), np.int64, int(n.sum()))
        out = np.zeros((len(seq), self.emit.shape[1]))
        np.add.at(out, np.repeat(np.arange(len(seq)), n), self.emit[flat])
        return out

    def viterbi(self, seq: Sequence[Sequence[int]]) -> list[int]:
        """The most likely labels. Ties go to the smaller label."""
        if not seq:
            return []
        s = self.scores(seq)
        best, back = self.begin + s[0], np.zeros(s.shape, np.int64)
        for i in range(1, len(seq)):
            ways = best[:, None] + self.step
            back[i] = ways.argmax(axis=0)
            best = ways.max(axis=0) + s[i]
        out = [int(best.argmax())]
        for i in range(len(seq) - 1, 0, -1):
            out.append(int(back[i][out[-1]]))
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(data: Sequence[tuple[Sequence[Sequence[int]], Sequence[int]]], features: int, labels: int, epochs: int = 8, rate: float = 0.4, decay: float = 1e-4, seed: int = 7, batch: int = 8) -> Crf:
    """Weights that fit ``data``, pairs of a sequence and its labels, by steps over ``batch`` sequences
    of like length at a time. The same data and seed give the same weights."""
    emit, step, begin = np.zeros((features, labels)), np.zeros((labels, labels)), np.zeros(labels)
    sq = [np.full_like(w, 1e-2) for w in (emit, step, begin)]
    by_length = sorted((d for d in range(len(data)) if len(data[d][0])), key=lambda d: len(data[d][0]))
    parts = [_padded([data[d] for d in by_length[i : i + batch]]) for i in range(0, len(by_length), batch)]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(parts)):
            grads = _gradient(*parts[k], emit, step, begin)
            for w, grad, total in zip((emit, step, begin), grads, sq, strict=True):
                grad = grad - decay * w
                total += grad * grad
                w += rate * grad / np.sqrt(total)
    return Crf(emit, step, begin)


def _padded(some: list[tuple[Sequence[Sequence[int]], Sequence[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, their places in a padded grid of positions by sequences, lengths, labels)."""
    n = np.array([len(seq) for seq, _ in some])
    gold = np.full((n.max(), len(some)), -1)
    flat, place = [], []
    for j, (seq, tags) in enumerate(some):
        gold[: n[j], j] = tags
        for i, fs in enumerate(seq):
            flat += fs
            place += [i * len(some) + j] * len(fs)
    return np.array(flat), np.array(place), n, gold


def _gradient(flat: np.ndarray, place: np.ndarray, n: np.ndarray, gold: np.ndarray, emit: np.ndarray, step: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """The log-likelihood's gradient, by forward-backward over all sequences at once."""
    m, many, labels = *gold.shape, len(begin)
    s = np.zeros((m * many, labels))
    np.add.at(s, place, emit[flat])
    s = s.reshape(m, many, labels)
    f, b = np.zeros_like(s), np.zeros_like(s)
    f[0] = begin + s[0]
    for i in range(1, m):
        f[i] = np.where((i < n)[:, None], _log_sum(f[i - 1][:, :, None] + step, 1) + s[i], f[i - 1])
    for i in range(m - 2, -1, -1):
        b[i] = np.where((i + 1 < n)[:, None], _log_sum(step + (s[i + 1] + b[i + 1])[:, None, :], 2), 0)
    z = _log_sum(f[-1], 1)
    held = gold >= 0
    there = (gold[:, :, None] == np.arange(labels)) * 1.0
    miss = (there - np.exp(f + b - z[:, None])) * held[:, :, None]
    of_emit, of_step = np.zeros_like(emit), np.zeros_like(step)
    np.add.at(of_emit, flat, miss.reshape(m * many, labels)[place])
    if m > 1:
        both = held[1:]
        np.add.at(of_step, (gold[:-1][both], gold[1:][both]), 1)
        of_step -= np.exp(f[:-1, :, :, None] + step + (s[1:] + b[1:])[:, :, None, :] - z[:, None, None])[both].sum(axis=0)
    return [of_emit, of_step, miss[0].sum(axis=0)]
