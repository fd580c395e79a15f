"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of equal depth: a split for every inner place and a value for every leaf, so a row's leaf is found by ``depth`` gathers. Each tree sees a random ``share`` of the features."""

    def __init__(self, rounds: int = 120, depth: int = 4, rate: float = 0.2, bins: int = 32, weight: float = 1.0, share: float = 0.4, seed: int = 3):
        self.rounds, self.depth, self.rate, self.bins, self.weight, self.share, self.seed = rounds, depth, rate, bins, weight, share, seed
        self.edges: list[np.ndarray] = []
        self.features = self.cuts = self.leaves = None
        self.start = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        grid = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], grid, method="lower")) for j in range(x.shape[1])]
        binned = self._bin(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        inner = (1 << self.depth) - 1
        self.features = np.zeros((self.rounds, inner), np.int64)
        self.cuts = np.full((self.rounds, inner), 255, np.int64)
        self.leaves = np.zeros((self.rounds, 1 << self.depth))
        margin, draw = np.full(len(y), self.start), np.random.default_rng(self.seed)
        columns = [np.ascontiguousarray(binned[:, j]).astype(np.int64) for j in range(x.shape[1])]
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            gradient, curve = y - p, np.maximum(p * (1 - p), 1e-6)
            place = np.zeros(len(y), np.int64)
            offered = draw.permutation(x.shape[1])[: max(1, round(self.share * x.shape[1]))]
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                best = np.full(width, 1e-6)
                for j in offered:
                    n = len(self.edges[j]) + 1
                    key = (place - first) * n + columns[j]
                    g = np.bincount(key, weights=gradient, minlength=width * n).reshape(width, n)
                    h = np.bincount(key, weights=curve, minlength=width * n).reshape(width, n)
                    gl, hl = g.cumsum(axis=1), h.cumsum(axis=1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + self.weight) + (gt - gl) ** 2 / (ht - hl + self.weight) - gt**2 / (ht + self.weight)
                    gain[(hl < 1) | (ht - hl < 1)] = 0
                    cut = gain.argmax(axis=1)
                    top = gain[np.arange(width), cut]
                    better = top > best
                    best[better] = top[better]
                    self.features[r, first : first + width][better] = j
                    self.cuts[r, first : first + width][better] = cut[better]
                place = self._down(binned, place, r)
            leaf = place - inner
            g = np.bincount(leaf, weights=gradient, minlength=inner + 1)
            h = np.bincount(leaf, weights=curve, minlength=inner + 1)
            self.leaves[r] = self.rate * g / (h + self.weight)
            margin += self.leaves[r][leaf]
        return self

    def _down(self, binned, place, r):
        right = binned[np.arange(len(binned)), self.features[r][place]] > self.cuts[r][place]
        return 2 * place + 1 + right

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        binned, out = self._bin(x), np.full(len(x), self.start)
        for r in range(self.rounds):
            place = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                place = self._down(binned, place, r)
            out += self.leaves[r][place - len(self.features[r])]
        return out
