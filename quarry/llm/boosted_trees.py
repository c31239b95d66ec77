"""Gradient-boosted trees for two classes, in numpy, by histograms of binned features; each tree grows on a share of the rows."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 100, depth: int = 5, rate: float = 0.2, bins: int = 32, least: float = 1.0, l2: float = 1.0, share: float = 0.25, seed: int = 3):
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.l2, self.share, self.seed = trees, depth, rate, bins, least, l2, share, seed
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: rows of features, y: 0 or 1."""
        for k in range(x.shape[1]):
            self.cuts.append(np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])))
        b = self._binned(x)
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        raw, rng = np.full(len(y), self.start), np.random.default_rng(self.seed)
        for _ in range(self.n_trees):
            some = np.flatnonzero(rng.random(len(y)) < self.share)
            p = 1 / (1 + np.exp(-raw[some]))
            self.trees.append(self._grow(b[some], p - y[some], p * (1 - p)))
            raw += self._values(b, self.trees[-1])
        return self

    def _values(self, b: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(b), dtype=int), np.arange(len(b))
        for _ in range(self.depth):
            k = feature[at]
            at = 2 * at + 1 + ((k >= 0) & (b[rows, np.maximum(k, 0)] > cut[at]))
        return value[at]

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        """A full tree, split level by level: (feature, bin, value) by node; a split on feature -1 sends all left."""
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, dtype=int), np.zeros(nodes)
        at = np.zeros(len(b), dtype=int)
        width = self.bins + 1
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            place = at - first
            gain_of, chosen = np.full(count, 1e-6), np.full((count, 2), -1)
            total_g, total_h = np.bincount(place, g, count), np.bincount(place, h, count)
            for k in range(b.shape[1]):
                slot = place * width + b[:, k]
                left_g = np.bincount(slot, g, count * width).reshape(count, width).cumsum(1)[:, :-1]
                left_h = np.bincount(slot, h, count * width).reshape(count, width).cumsum(1)[:, :-1]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + self.l2) + right_g**2 / (right_h + self.l2) - (total_g**2 / (total_h + self.l2))[:, None]
                gain[(left_h < self.least) | (right_h < self.least)] = 0
                best = gain.argmax(1)
                better = gain[np.arange(count), best] > gain_of
                gain_of[better] = gain[np.arange(count), best][better]
                chosen[better, 0], chosen[better, 1] = k, best[better]
            feature[first : first + count], cut[first : first + count] = chosen[:, 0], chosen[:, 1]
            k = feature[at]
            at = 2 * at + 1 + ((k >= 0) & (b[np.arange(len(b)), np.maximum(k, 0)] > cut[at]))
        leaves = np.arange(nodes)
        value[leaves] = -self.rate * np.bincount(at, g, nodes) / (np.bincount(at, h, nodes) + self.l2)
        return feature, cut, value

    def margin(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        if not len(x):
            return raw
        b = self._binned(x)
        for tree in self.trees:
            raw += self._values(b, tree)
        return raw
