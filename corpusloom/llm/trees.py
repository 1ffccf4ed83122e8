"""Gradient-boosted regression trees in numpy, with monotonic constraints, flattened into node arrays."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in one set of node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Prediction (log odds, or the value itself after squared loss) of each row of ``x``; a NaN goes left."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go_right = x[rows, self.feature[at]] > self.threshold[at]
            at = np.where(go_right, self.right[at], self.left[at])
        return self.base + self.value[at].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 48, ridge: float = 1.0, squared: bool = False) -> Forest:
    """Boosting on histograms, logistic or with ``squared`` loss. ``monotone``: 1, 0 or -1 for each feature; a score never falls as a +1 feature grows.

    A split on a constrained feature is taken only if its leaf values stand in the right order; the values of the two
    sides are then bounded by their mean, so that deeper splits keep the order. Labels of one class (or value) give a constant.
    """
    n, k = x.shape
    p0 = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = (float(y.mean()) if n else 0.0) if squared else float(np.log(p0 / (1 - p0)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.array([]) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(k)], axis=1) if n else np.zeros((0, k), int)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    score = np.full(n, base)

    def leaf_value(g, h, lo, hi):
        return float(np.clip(-g / (h + ridge), lo, hi))

    def grow(idx, g, h, level, lo, hi) -> int:
        me = len(feature)
        for a, v in ((feature, 0), (threshold, np.inf), (left, me), (right, me), (value, leaf_value(g[idx].sum(), h[idx].sum(), lo, hi) * rate)):
            a.append(v)
        if level == depth or len(idx) < 20:
            return me
        gt, ht = g[idx].sum(), h[idx].sum()
        best = (1e-6, None)
        for j in range(k):
            if not len(edges[j]):
                continue
            b = binned[idx, j]
            gl = np.cumsum(np.bincount(b, g[idx], len(edges[j]) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[idx], len(edges[j]) + 1))[:-1]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-(gt - gl) / (ht - hl + ridge), lo, hi)
            gain[(hl < 1e-3) | (ht - hl < 1e-3) | (monotone[j] * (vr - vl) < 0)] = 0
            c = int(gain.argmax())
            if gain[c] > best[0]:
                best = (gain[c], (j, c, float(vl[c]), float(vr[c])))
        if best[1] is None:
            return me
        j, c, vl, vr = best[1]
        mid = (vl + vr) / 2
        bl, br = ((lo, mid), (mid, hi)) if monotone[j] > 0 else ((mid, hi), (lo, mid)) if monotone[j] < 0 else ((lo, hi), (lo, hi))
        go_right = binned[idx, j] > c
        feature[me], threshold[me] = j, float(edges[j][c])
        left[me] = grow(idx[~go_right], g, h, level + 1, *bl)
        right[me] = grow(idx[go_right], g, h, level + 1, *br)
        return me

    for _ in range(trees if n and y.min() < y.max() else 0):
        p = score if squared else 1 / (1 + np.exp(-score))
        root = grow(np.arange(n), p - y, np.ones(n) if squared else np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf)
        roots.append(root)
        one = Forest(*map(np.array, (feature, threshold, left, right, value)), np.array([root]), depth, 0.0)
        score = score + one.score(x)
    if not roots:
        feature, threshold, left, right, value, roots = [0], [np.inf], [0], [0], [0.0], [0]
    return Forest(np.array(feature), np.array(threshold, float), np.array(left), np.array(right), np.array(value, float), np.array(roots), depth, base)
