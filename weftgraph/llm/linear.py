"""A regularized linear classifier on hashed features, small enough to train on the driver from a bounded sample."""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np

#: Hash space of features.
BITS = 18


class Hasher(dict):
    """Hash numbers of tokens, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[token] = zlib.crc32(token.encode("utf-8", "replace"))
        return h


def ngrams(rows: list[list[str]], hasher: Hasher, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of the unigrams and bigrams of every row's tokens, row after row, and how many each row has."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    total = int(lengths.sum())
    numbers = np.fromiter(map(hasher.__getitem__, chain.from_iterable(rows)), np.int64, total)
    mask = (1 << bits) - 1
    out = np.empty(2 * total, np.int64)
    out[0::2] = numbers & mask
    out[1::2] = ((numbers * 0x9E3779B1) ^ (np.append(numbers[1:], [0] * min(1, total)) * 0x85EBCA6B)) >> 7 & mask
    keep = np.ones(2 * total, bool)
    ends = np.cumsum(lengths)[lengths > 0]
    keep[2 * ends - 1] = False
    return out[keep], np.maximum(2 * lengths - 1, 0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(columns: np.ndarray, sizes: np.ndarray, labels: np.ndarray, l2: float = 1e-4, rounds: int = 120, bits: int = BITS) -> np.ndarray:
    """Weights (the last is the intercept) of an L2-regularized logistic regression with balanced classes, by Adam over all rows.

    With no rows or one class only, a constant: the log-odds of a small or large probability.
    """
    w = np.zeros((1 << bits) + 1)
    y = np.asarray(labels, float)
    if len(y) == 0 or y.min() == y.max():
        w[-1] = 10.0 if len(y) and y[0] else -10.0
        return w
    n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    value = (1 / np.sqrt(np.maximum(sizes, 1)))[owner]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    used, columns = np.unique(columns, return_inverse=True)
    v, b = np.zeros(len(used)), 0.0
    m, s, mb, sb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, rounds + 1):
        error = (sigmoid(np.bincount(owner, v[columns] * value, n) + b) - y) * weight
        g, gb = np.bincount(columns, error[owner] * value, len(used)) + l2 * v, error.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate = 0.3 / (1 - 0.9**t) * np.sqrt(1 - 0.99**t)
        v, b = v - rate * m / (np.sqrt(s) + 1e-9), b - rate * mb / (np.sqrt(sb) + 1e-9)
    w[used], w[-1] = v, b
    return w


def score(columns: np.ndarray, sizes: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Probabilities of the positive class."""
    total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), w[columns], len(sizes))
    return sigmoid(total / np.sqrt(np.maximum(sizes, 1)) + w[-1])
