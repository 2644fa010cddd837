"""Gradient-boosted trees for two classes, in numpy: binned features, logistic loss, complete trees of fixed depth."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Each tree is complete: node k of a level has children 2k and 2k + 1; rows go right where the value exceeds the cut."""

    def __init__(self, depth: int = 5, rounds: int = 80, rate: float = 0.2, bins: int = 32, smooth: float = 2.0):
        self.depth, self.rounds, self.rate, self.bins, self.smooth = depth, rounds, rate, bins, smooth
        self.trees: list[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # x <= e[b] iff bin <= b
        width = self.bins + 1
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            node, features, cuts = np.zeros(len(y), dtype=np.int64), [], []
            for level in range(self.depth):
                n = 1 << level
                best, feature, cut = np.full(n, 1e-9), np.zeros(n, dtype=np.int64), np.full(n, np.inf)
                bin_cut = np.full(n, width, dtype=np.int64)
                total_g, total_h = np.bincount(node, grad, n), np.bincount(node, hess, n)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = node * width + binned[:, j]
                    g = np.bincount(key, grad, n * width).reshape(n, width).cumsum(1)[:, : len(e)]
                    h = np.bincount(key, hess, n * width).reshape(n, width).cumsum(1)[:, : len(e)]
                    rg, rh = total_g[:, None] - g, total_h[:, None] - h
                    gain = g**2 / (h + self.smooth) + rg**2 / (rh + self.smooth) - (total_g**2 / (total_h + self.smooth))[:, None]
                    gain[(h < 1) | (rh < 1)] = 0
                    b = gain.argmax(1)
                    better = gain[np.arange(n), b] > best
                    best[better], feature[better], bin_cut[better], cut[better] = gain[np.arange(n), b][better], j, b[better], e[b[better]]
                features.append(feature)
                cuts.append(cut)
                node = 2 * node + (binned[np.arange(len(y)), feature[node]] > bin_cut[node])
            n = 1 << self.depth
            leaf = self.rate * np.bincount(node, grad, n) / (np.bincount(node, hess, n) + self.smooth)
            margin += leaf[node]
            self.trees.append((features, cuts, leaf))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1."""
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for features, cuts, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for feature, cut in zip(features, cuts, strict=True):
                node = 2 * node + (x[rows, feature[node]] > cut[node])
            margin += leaf[node]
        return 1 / (1 + np.exp(-margin))
