"""A small classification tree (Gini, binary splits), trained in memory on a bounded labelled table."""

from __future__ import annotations

import numpy as np


class Tree:
    def __init__(self, max_depth: int = 6, min_leaf: int = 1):
        self.max_depth, self.min_leaf = max_depth, min_leaf
        self.nodes: list[tuple] = []  # (feature, threshold, left, right) or (label,)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self.classes, codes = np.unique(y, return_inverse=True)
        self._grow(np.asarray(x, float), codes, 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append((int(np.bincount(y).argmax()),))
        if depth == self.max_depth or len(set(y.tolist())) == 1:
            return at
        best, base = None, self._gini(y) * len(y)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[:-1] + values[1:]) / 2:
                left = x[:, f] <= t
                n = int(left.sum())
                if min(n, len(y) - n) < self.min_leaf:
                    continue
                score = self._gini(y[left]) * n + self._gini(y[~left]) * (len(y) - n)
                if best is None or score < best[0] - 1e-12:
                    best = (score, f, t)
        if best is None or best[0] >= base - 1e-9:
            return at
        _, f, t = best
        left = x[:, f] <= t
        a = self._grow(x[left], y[left], depth + 1)
        b = self._grow(x[~left], y[~left], depth + 1)
        self.nodes[at] = (f, float(t), a, b)
        return at

    @staticmethod
    def _gini(y: np.ndarray) -> float:
        p = np.bincount(y) / len(y)
        return float(1 - (p * p).sum())

    def label(self, row) -> str:
        node = self.nodes[0]
        while len(node) == 4:
            node = self.nodes[node[2] if row[node[0]] <= node[1] else node[3]]
        return str(self.classes[node[0]])
