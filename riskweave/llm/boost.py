"""Gradient-boosted trees for a yes/no target, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    base: float
    #: per tree, in heap order: the feature (-1 at a leaf), the threshold, and the leaf's value
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        every = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                k = f[at]
                down = 2 * at + 1 + (x[every, np.maximum(k, 0)] > t[at])
                at = np.where(k >= 0, down, at)
            out += v[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 4.0) -> Boosted:
    """Second-order boosting; each split maximises the gain of the summed gradients over histograms."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    size = 2 ** (depth + 1) - 1
    out = Boosted(base, np.full((trees, size), -1, np.int64), np.zeros((trees, size)), np.zeros((trees, size)), depth)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, -1)
            if node < size // 2 and hs > 2 * least / 4:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(hl < least / 4) | (hs - hl < least / 4)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] < 0:
                out.value[t, node] = rate * gs / (hs + ridge)
                score[rows] += out.value[t, node]
                continue
            out.feature[t, node], out.threshold[t, node] = best[1], cuts[best[1]][best[2]]
            at[rows] = 2 * node + 1 + (binned[rows, best[1]] > best[2])
    return out
