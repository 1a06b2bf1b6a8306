"""Which pairs of two lists of strings can reach a longest-matching-blocks ratio, by upper bounds that lose no pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Buckets that letters are counted in; letters that share one only loosen the bounds.
BUCKETS = 64
#: Strings of either list that are compared at once, and pairs whose common subsequence is measured at once.
ROWS, PAIRS = 2048, 50_000


def letters(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the letters, one string a row, filled up with ``BUCKETS``, and the lengths."""
    sizes = np.array([len(x) for x in strings], np.int64)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.full((len(strings), int(sizes.max(initial=0))), BUCKETS, np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.where((flat >= 97) & (flat < 123), flat - 97, 26 + flat % (BUCKETS - 26))
    return out, sizes


def _counts(codes: np.ndarray) -> np.ndarray:
    at = np.arange(len(codes))[:, None] * (BUCKETS + 1) + codes
    return np.bincount(at.ravel(), minlength=len(codes) * (BUCKETS + 1)).reshape(len(codes), -1)[:, :BUCKETS]


def _masks(codes: np.ndarray) -> np.ndarray:
    """For each string and bucket the bits of its first 64 places that hold it; none for the filling."""
    out = np.zeros((len(codes), BUCKETS + 1), np.uint64)
    rows = np.arange(len(codes))
    for place in range(min(64, codes.shape[1])):
        out[rows, codes[:, place]] |= np.uint64(1 << place)
    out[:, BUCKETS] = 0
    return out


def _subsequence(masks: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair: ``masks`` and ``sizes`` of one side, at most 64 letters, ``codes`` of the other."""
    open_ = np.full(len(sizes), ~np.uint64(0))
    rows = np.arange(len(sizes))
    for place in range(codes.shape[1]):
        met = open_ & masks[rows, codes[:, place]]
        open_ = (open_ + met) | (open_ - met)
    return np.bitwise_count(~open_ & (~np.uint64(0) >> (64 - sizes).astype(np.uint64)))


def _unary(counts: np.ndarray, most: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """Counts as rows of ones, so that a product of two rows adds up the smaller counts."""
    return np.concatenate([*(counts[:, [c]] >= np.arange(1, n + 1) for c, n in enumerate(most) if n), *(x[:, None] for x in rest)], 1, dtype=np.float32)


def near_pairs(a: list[str], b: list[str], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and in ``b`` of every pair whose ratio can be ``least`` or more.

    A ratio is twice the letters of matching blocks over both lengths, and these letters are common to both and
    stand in one order. So a pair leaves only if its common letters, or its longest common subsequence, are too few.
    """
    if not a or not b:
        return
    (codes_a, sizes_a), (codes_b, sizes_b) = letters(a), letters(b)
    counts_a, counts_b = _counts(codes_a), _counts(codes_b)
    masks_a, masks_b = _masks(codes_a), _masks(codes_b)
    for i in range(0, len(a), ROWS):
        for j in range(0, len(b), ROWS):
            x, y = slice(i, i + ROWS), slice(j, j + ROWS)
            most = np.minimum(counts_a[x].max(0), counts_b[y].max(0))
            need_a, need_b = sizes_a[x] * (least / 2), sizes_b[y] * (least / 2)
            left = _unary(counts_a[x], most, -need_a, np.ones(len(need_a)))
            right = _unary(counts_b[y], most, np.ones(len(need_b)), -need_b)
            p, q = np.divmod(np.flatnonzero(left @ right.T >= -0.01), len(right))  # room for rounding
            p, q = p + i, q + j
            for at in range(0, len(p), PAIRS):
                yield from _measured(p[at : at + PAIRS], q[at : at + PAIRS], codes_a, sizes_a, masks_a, codes_b, sizes_b, masks_b, least)


def _measured(p, q, codes_a, sizes_a, masks_a, codes_b, sizes_b, masks_b, least) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    m, n = sizes_a[p], sizes_b[q]
    sides = (m <= n) & (m <= 64), (n < m) & (n <= 64)
    long = ~(sides[0] | sides[1])  # both too long for one word of bits: the counts alone decide
    if long.any():
        yield p[long], q[long]
    for first, side in zip((True, False), sides, strict=True):
        if side.any():
            r, s = p[side], q[side]
            short, other = (r, s) if first else (s, r)
            masks, sizes, codes, wide = (masks_a[short], sizes_a[short], codes_b[other], sizes_b[other]) if first else (masks_b[short], sizes_b[short], codes_a[other], sizes_a[other])
            common = _subsequence(masks, sizes, codes[:, : int(wide.max())])
            kept = 2 * common >= least * (sizes + wide) - 1e-6
            yield r[kept], s[kept]
