"""Gradient boosted trees for a binary target, in numpy: histogram splits, logistic loss."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of equal depth kept as arrays: at each inner node a feature and a cut, at each leaf a value."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.smooth = rounds, depth, rate, bins, smooth
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scale, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, cuts, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += self._walk(tree, x)
        return self

    def _grow(self, binned: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        leaf = np.zeros(inner + 1)
        node = np.zeros(len(residual), dtype=np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = 1e-9
            for f in range(binned.shape[1]):
                if not len(cuts[f]) or not len(rows):
                    continue
                g = np.bincount(binned[rows, f], weights=residual[rows], minlength=len(cuts[f]) + 1).cumsum()
                h = np.bincount(binned[rows, f], weights=weight[rows], minlength=len(cuts[f]) + 1).cumsum()
                left, right = g[:-1] ** 2 / (h[:-1] + self.smooth), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + self.smooth)
                gain = left + right - g[-1] ** 2 / (h[-1] + self.smooth)
                at = int(gain.argmax())
                if gain[at] > best:
                    best, feature[k], cut[k] = float(gain[at]), f, cuts[f][at]
            go = binned[rows, feature[k]] > np.searchsorted(cuts[feature[k]], cut[k], "left") if np.isfinite(cut[k]) else np.zeros(len(rows), dtype=bool)
            node[rows] = 2 * k + 1 + go
        for k in range(inner + 1):
            rows = node == inner + k
            leaf[k] = self.rate * residual[rows].sum() / (weight[rows].sum() + self.smooth)
        return feature, cut, leaf

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        return leaf[node - len(feature)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt scaling on rows that were not fitted."""
        m = self.margin(x)
        a, b = 1.0, 0.0
        for _ in range(500):
            p = 1 / (1 + np.exp(-(a * m + b)))
            a -= 0.05 * float(((p - y) * m).mean())
            b -= 0.05 * float((p - y).mean())
        self.scale, self.shift = a, b
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.margin(x) + self.shift)))
