"""Gradient-boosted regression trees on binned features (NumPy, squared error), small enough to train on the driver."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of a fixed depth in arrays: split feature, split bin and the values of the leaves."""

    def __init__(self, rounds: int = 90, depth: int = 4, rate: float = 0.09, bins: int = 48, least: int = 12, ridge: float = 3.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, seed: int = 0) -> Boosted:
        rng = np.random.default_rng(seed)
        w = np.ones(len(y)) if weight is None else weight
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self.binned(x)
        self.base = float(np.average(y, weights=w))
        self.feature = np.zeros((self.rounds, 2**self.depth - 1), dtype=np.int16)
        self.cut = np.full((self.rounds, 2**self.depth - 1), 255, dtype=np.uint8)
        self.leaf = np.zeros((self.rounds, 2**self.depth))
        current = np.full(len(y), self.base)
        for t in range(self.rounds):
            rows = rng.random(len(y)) < 0.8
            g, h, xb = ((y - current) * w)[rows], w[rows], b[rows]
            node = np.zeros(len(g), dtype=np.int64)
            features = np.flatnonzero(rng.random(x.shape[1]) < 0.6)
            features = features if len(features) else np.arange(x.shape[1])
            for level in range(self.depth):
                size = 2**level
                best = np.full(size, 1e-9)
                for f in features:
                    key = node * self.bins + xb[:, f]
                    sums = np.bincount(key, weights=g, minlength=size * self.bins).reshape(size, self.bins).cumsum(axis=1)
                    mass = np.bincount(key, weights=h, minlength=size * self.bins).reshape(size, self.bins).cumsum(axis=1)
                    left, n = sums[:, :-1], mass[:, :-1]
                    total, all_ = sums[:, -1:], mass[:, -1:]
                    gain = left**2 / (n + self.ridge) + (total - left) ** 2 / (all_ - n + self.ridge) - total**2 / (all_ + self.ridge)
                    gain[(n < self.least) | (all_ - n < self.least)] = 0
                    at = gain.argmax(axis=1)
                    found = gain[np.arange(size), at]
                    better = found > best
                    best[better] = found[better]
                    self.feature[t, size - 1 : 2 * size - 1][better] = f
                    self.cut[t, size - 1 : 2 * size - 1][better] = at[better]
                node = 2 * node + (xb[np.arange(len(node)), self.feature[t, size - 1 + node]] > self.cut[t, size - 1 + node])
            mass = np.bincount(node, weights=h, minlength=2**self.depth)
            self.leaf[t] = self.rate * np.bincount(node, weights=g, minlength=2**self.depth) / (mass + self.ridge)
            current += self.leaf[t, self._leaves(b, t)]
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1).astype(np.uint8)

    def _leaves(self, b: np.ndarray, t: int) -> np.ndarray:
        node = np.zeros(len(b), dtype=np.int64)
        every = np.arange(len(b))
        for level in range(self.depth):
            at = 2**level - 1 + node
            node = 2 * node + (b[every, self.feature[t, at]] > self.cut[t, at])
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.base + sum(self.leaf[t, self._leaves(b, t)] for t in range(self.rounds))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on x (pool adjacent violators), for np.interp."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, sum of x, count
    for xi, yi in zip(x[order], y[order]):
        blocks.append([yi, xi, 1.0])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][2] >= blocks[-1][0] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([s / n for _, s, n in blocks]), np.array([s / n for s, _, n in blocks])
