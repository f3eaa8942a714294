"""Small gradient-boosted trees in numpy, flattened into node arrays for vectorised scoring.

Training is on one bounded matrix (the caller bounds it).  Splits are found on histograms; a feature with a
monotonic constraint may only be split so that scores never move against its sign, and the bounds set by such a
split hold for everything below it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees in one set of node arrays. ``feature`` is -1 at a leaf; a row goes left if value <= threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds per row, all trees of all rows at once, one level at a time."""
        if len(x) == 0:
            return np.zeros(0)
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            down = np.where(x[row, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(f < 0, node, down)
        return self.base + self.value[node].sum(axis=1)


def train(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Forest:
    """Logistic boosting. ``signs``: per feature 1 (score may only rise with it), -1 (only fall) or 0 (free)."""
    n, d = x.shape
    mean = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    if n == 0 or y.min() == y.max():
        roots.append(node())
    else:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        code = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            roots.append(root := node())
            open_nodes = [(root, np.arange(n), -np.inf, np.inf, 0)]
            while open_nodes:
                at, ids, low, high, level = open_nodes.pop()
                g, h = grad[ids].sum(), hess[ids].sum()
                here = float(np.clip(g / (h + ridge), low, high))
                best = (1e-6, None)
                if level < depth and len(ids) >= 2 * least:
                    for j in range(d):
                        c, size = code[ids, j], len(edges[j]) + 1
                        if size < 2:
                            continue
                        gl, hl, nl = (np.cumsum(np.bincount(c, w, size))[:-1] for w in (grad[ids], hess[ids], None))
                        vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((g - gl) / (h - hl + ridge), low, high)
                        gain = 2 * gl * vl - (hl + ridge) * vl**2 + 2 * (g - gl) * vr - (h - hl + ridge) * vr**2 - (2 * g * here - (h + ridge) * here**2)
                        gain[(nl < least) | (len(ids) - nl < least) | (signs[j] * (vr - vl) < 0)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
                if best[1] is None:
                    value[at] = rate * here
                    margin[ids] += rate * here
                    continue
                j, k, vl, vr = best[1]
                feature[at], threshold[at], left[at], right[at] = j, float(edges[j][k]), node(), node()
                middle, goes = (vl + vr) / 2, code[ids, j] <= k
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[j]]
                open_nodes.append((left[at], ids[goes], *bounds[0], level + 1))
                open_nodes.append((right[at], ids[~goes], *bounds[1], level + 1))
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)
