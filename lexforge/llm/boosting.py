"""Gradient-boosted trees for a binary target: depth-limited, histogram splits, logistic loss. Small, seeded, numpy only."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    least: float = 4.0
    base: float = 0.0
    #: Each tree: split feature (-1: leaf), threshold, leaf value; children of node i are 2 i + 1 and 2 i + 2.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        cell = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, where = self._grow(cell, edges, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            score += tree[2][where]
        return self

    def _grow(self, cell, edges, grad, hess):
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(grad), np.int64)
        for node in range(nodes):
            mine = np.flatnonzero(at == node)
            if not mine.size:
                continue
            g, h = grad[mine].sum(), hess[mine].sum()
            value[node] = -self.rate * g / (h + 1.0)
            if node >= 2**self.depth - 1:
                continue
            best = (1e-3, -1, 0)
            for f, e in enumerate(edges):
                if not e.size:
                    continue
                gs = np.cumsum(np.bincount(cell[mine, f], grad[mine], e.size + 1))[:-1]
                hs = np.cumsum(np.bincount(cell[mine, f], hess[mine], e.size + 1))[:-1]
                gain = np.where((hs > self.least / 4) & (h - hs > self.least / 4), gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], edges[best[1]][best[2]]
                at[mine] = np.where(cell[mine, best[1]] <= best[2], 2 * node + 1, 2 * node + 2)
        return (feature, cut, value), at

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] <= cut[at], 2 * at + 1, 2 * at + 2))
            score += value[at]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt scaling on rows that were held out of ``fit``."""
        z, a, b = self.raw(x), 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(a * z + b)))
            w = p * (1 - p) + 1e-6
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, np.array([((p - y) * z).sum(), (p - y).sum()]))
            a, b = a - step[0], b - step[1]
        self.slope, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))
