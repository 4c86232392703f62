"""A random forest in numpy, fitted on a bounded sample and applied to batches."""

from __future__ import annotations

import numpy as np


def _bins(x: np.ndarray, count: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, count + 1)[1:-1])) for c in x.T]


class Forest:
    """Bagged trees with a random choice of features at each split; Gini impurity on binned values."""

    def __init__(self, trees: int = 32, depth: int = 9, leaf: int = 5, bins: int = 32, seed: int = 7):
        self.trees, self.depth, self.leaf, self.bins, self.seed = trees, depth, leaf, bins, seed
        self.edges: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        """``y`` is 0 or 1; the rarer class weighs as if it were the square root as rare."""
        rng = np.random.default_rng(self.seed)
        self.edges = _bins(x, self.bins)
        codes = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1).astype(np.int16)
        weight = np.where(y > 0, np.sqrt(max(1.0, (1 - y).sum()) / max(1, y.sum())), 1.0)
        tries = max(2, int(np.ceil(np.sqrt(x.shape[1]))))
        for _ in range(self.trees):
            rows = rng.integers(0, len(y), len(y))
            self.nodes.append(self._grow(codes[rows], y[rows].astype(float), weight[rows], rng, tries))
        return self

    def _grow(self, codes, y, weight, rng, tries):
        feature, cut, left, right, value = [], [], [], [], []

        def node(rows, depth):
            me = len(feature)
            w = weight[rows]
            p = float((w * y[rows]).sum() / w.sum())
            for column, v in zip((feature, cut, left, right, value), (-1, 0, -1, -1, p)):
                column.append(v)
            if depth == self.depth or len(rows) < 2 * self.leaf or p in (0.0, 1.0):
                return me
            best = (1e-12, -1, 0)
            total, positive = w.sum(), (w * y[rows]).sum()
            parent = total * 2 * p * (1 - p)
            for f in rng.permutation(codes.shape[1])[: tries * 2]:
                c = codes[rows, f]
                size = len(self.edges[f]) + 1
                ws = np.cumsum(np.bincount(c, w, size))[:-1]
                ps = np.cumsum(np.bincount(c, w * y[rows], size))[:-1]
                ns = np.cumsum(np.bincount(c, minlength=size))[:-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = parent - 2 * ps * (1 - ps / ws) - 2 * (positive - ps) * (1 - (positive - ps) / (total - ws))
                gain[(ns < self.leaf) | (len(rows) - ns < self.leaf)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
            if best[1] < 0:
                return me
            feature[me], cut[me] = int(best[1]), best[2]
            below = codes[rows, best[1]] <= best[2]
            left[me] = node(rows[below], depth + 1)
            right[me] = node(rows[~below], depth + 1)
            return me

        node(np.arange(len(y)), 0)
        return tuple(np.array(c) for c in (feature, cut, left, right, value))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of the positive class over the trees."""
        if not len(x) or not self.nodes:
            return np.zeros(len(x))
        codes = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1)
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[at]
                go = f >= 0
                if not go.any():
                    break
                below = codes[rows, np.maximum(f, 0)] <= cut[at]
                at = np.where(go, np.where(below, left[at], right[at]), at)
            out += value[at]
        return out / max(1, len(self.nodes))
