"""Gradient boosting of small regression trees on logistic loss, and a calibrated threshold.

Fitted on the driver from a bounded sample; the fitted trees are a few arrays that travel to every
task. Features are cut at quantiles of the sample, so a split is a comparison with one number.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, weight: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.weight = trees, depth, rate, bins, weight
        self.base, self.nodes = 0.0, []
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree, margin = self._grow(binned, edges, y - p, p * (1 - p), margin)
            self.nodes.append(tree)
        return self

    def _grow(self, binned, edges, gradient, curvature, margin):
        """Nodes as (feature, cut, left value or next, ...) in heap order; a leaf has feature -1."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        where = np.zeros(len(gradient), dtype=np.int64)
        for node in range(size):
            rows = np.flatnonzero(where == node)
            if not len(rows):
                continue
            g, h = gradient[rows].sum(), curvature[rows].sum()
            value[node] = self.rate * g / (h + self.weight)
            if node >= size // 2:
                continue
            best = (1e-6, -1, 0)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                code = binned[rows, f]
                left_g = np.cumsum(np.bincount(code, gradient[rows], len(e) + 1))[:-1]
                left_h = np.cumsum(np.bincount(code, curvature[rows], len(e) + 1))[:-1]
                gain = left_g**2 / (left_h + self.weight) + (g - left_g) ** 2 / (h - left_h + self.weight)
                at = int(gain.argmax())
                gain = gain[at] - g * g / (h + self.weight)
                if gain > best[0]:
                    best = (gain, f, at)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], edges[best[1]][best[2]]
                right = binned[rows, best[1]] > best[2]
                where[rows] = 2 * node + 1 + right
        return (feature, cut, value), margin + value[where]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += value[at]
        return total

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> Boosted:
        """Map margins to probabilities on rows that were not fitted, and find the lowest threshold
        from which on at least ``precision`` of the chosen rows are right, one half at the least."""
        m = self.margin(x)
        a, b = 1.0, 0.0
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * m + b)))
            w = p * (1 - p) + 1e-9
            g = np.array([((target - p) * m).sum() - 1e-3 * (a - 1), (target - p).sum() - 1e-3 * b])
            hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
            step = np.clip(np.linalg.solve(hess, g), -2, 2)
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.slope, self.shift = float(max(a, 1e-3)), float(b)
        p = self.probability(x)
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        # a threshold cannot part equal scores
        last = np.append(p[order][1:] != p[order][:-1], True)
        good = np.flatnonzero((right >= precision) & last)
        self.threshold = max(0.5, float(p[order][good[-1]])) if len(good) else 0.5
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))
