"""Gradient-boosted trees for two classes on small dense samples, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Complete trees of one depth: feature and threshold of each inner node, value of each leaf."""

    features: np.ndarray  # (trees, inner)
    thresholds: np.ndarray
    leaves: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the first class."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1])) if len(self.leaves) else 0
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (len(leaf) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.score(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, weight: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; splits at quantiles of the sample."""
    x = np.asarray(x, np.float64)
    y = np.asarray(y, np.float64)
    inner, ends = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        base = 0.0 if len(y) == 0 else (8.0 if y[0] > 0.5 else -8.0)
        return Boosted(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, ends)), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
    mean = y.mean()
    base = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for n in range(inner):
            rows = np.flatnonzero(node == n)
            best = (1e-6, -1, 0)
            if len(rows) > 1:
                gs, hs = g[rows].sum(), h[rows].sum()
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.bincount(code[rows, f], g[rows], len(c) + 1).cumsum()[:-1]
                    hl = np.bincount(code[rows, f], h[rows], len(c) + 1).cumsum()[:-1]
                    gain = gl**2 / (hl + weight) + (gs - gl) ** 2 / (hs - hl + weight) - gs**2 / (hs + weight)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
            if best[1] >= 0:
                feature[n], threshold[n] = best[1], cuts[best[1]][best[2]]
            right = x[rows, feature[n]] > threshold[n]
            node[rows] = 2 * n + 1 + right
        leaf = node - inner
        sums = np.bincount(leaf, g, ends) / (np.bincount(leaf, h, ends) + weight) * rate
        total += sums[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(sums)
    return Boosted(np.array(features), np.array(thresholds), np.array(leaves), base)
