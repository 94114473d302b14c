"""Histogram gradient-boosted trees in numpy, flattened into arrays for vectorised traversal."""

from __future__ import annotations

import numpy as np

BINS = 64


class Trees:
    """Complete binary trees of one depth: node i has the children 2 i + 1 and 2 i + 2; a closed node sends all rows left."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.feature = np.zeros((0, (1 << depth) - 1), np.int32)
        self.threshold = np.zeros((0, (1 << depth) - 1), np.float64)
        self.value = np.zeros((0, 1 << depth), np.float64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, least: float = 4.0) -> Trees:
    """Newton boosting of the weighted logistic loss over at most BINS quantile bins a feature."""
    mean = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 0.01, 0.99) if len(y) else 0.5
    model = Trees(float(np.log(mean / (1 - mean))), depth)
    if len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    n, width = x.shape
    cell = binned + np.arange(width) * BINS
    margin = np.full(n, model.base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros((1 << depth) - 1, np.int32), np.full((1 << depth) - 1, np.inf)
        for level in range(depth):
            k, first = 1 << level, (1 << level) - 1
            at = ((node - first)[:, None] * (width * BINS) + cell).ravel()
            gs, hs = (np.bincount(at, np.repeat(v, width), k * width * BINS).reshape(k, width, BINS).cumsum(2) for v in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < least) | (ht - hs < least)] = 0
            flat = gain.reshape(k, -1)
            best = flat.argmax(1)
            for i in range(k):
                j, b = divmod(int(best[i]), BINS)
                if flat[i, best[i]] > 1e-6 and b < len(edges[j]):
                    feature[first + i], threshold[first + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - len(feature)
        value = -rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
        margin += value[leaf]
        features.append(feature), thresholds.append(threshold), values.append(value)
    model.feature, model.threshold, model.value = np.array(features), np.array(thresholds), np.array(values)
    return model
