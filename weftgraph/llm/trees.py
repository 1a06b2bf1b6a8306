"""Gradient-boosted trees on small integer features, trained on the driver from a bounded sample or from counted rows."""

from __future__ import annotations

import numpy as np

from weftgraph.llm.linear import sigmoid

#: Feature values are clipped to this many bins.
BINS = 32


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: float, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One complete tree: feature and cut of every inner node in heap order, and the value of every leaf."""
    inner = (1 << depth) - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
    node = np.zeros(len(x), np.int64)
    for level in range(depth):
        first, width = (1 << level) - 1, 1 << level
        at = node - first
        best = np.full(width, 1e-9)
        for f in range(x.shape[1]):
            key = at * BINS + x[:, f]
            gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)
            hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)
            gt, ht = gs[:, -1:], hs[:, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < least) | (ht - hs < least)] = 0
            k = gain.argmax(1)
            top = gain[np.arange(width), k]
            better = top > best
            best[better] = top[better]
            feature[first : first + width][better] = f
            cut[first : first + width][better] = k[better]
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
    leaf = node - inner
    n = 1 << depth
    return feature, cut, -np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + l2)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, l2: float = 1.0, w: np.ndarray | None = None) -> dict:
    """Boosted logistic trees, a row counted ``w`` times; a constant when there is one class only."""
    x, y = np.clip(x, 0, BINS - 1).astype(np.int64), np.asarray(y, float)
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    share = np.clip((w * y).sum() / w.sum() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    trees, margin = [], np.full(len(y), base)
    if len(y) and 0 < y.sum() < len(y):
        for _ in range(rounds):
            p = sigmoid(margin)
            feature, cut, value = _grow(x, w * (p - y), w * np.maximum(p * (1 - p), 1e-6), depth, 1.0, l2)
            trees.append((feature, cut, value * rate))
            margin += predict_one(x, *trees[-1])
    return {"base": base, "trees": trees}


def predict_one(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(int(np.log2(len(value)))):
        node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
    return value[node - len(feature)]


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities."""
    x = np.clip(x, 0, BINS - 1).astype(np.int64)
    margin = np.full(len(x), model["base"])
    for tree in model["trees"]:
        margin += predict_one(x, *tree)
    return sigmoid(margin)
