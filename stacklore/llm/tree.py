"""A small decision tree (Gini), trained and applied on arrays."""

from __future__ import annotations

import numpy as np


class DecisionTree:
    def __init__(self, x: np.ndarray, y: np.ndarray, most: int = 24):
        """Train on rows ``x`` with labels ``y``, down to pure leaves or depth ``most``."""
        self.labels, codes = np.unique(y, return_inverse=True)
        self.nodes: list[tuple[int, float, int, int]] = []  # feature (-1: leaf), bound, left or label, right
        self._grow(x.astype(float), codes, most)

    def _grow(self, x, y, left_depth) -> int:
        at = len(self.nodes)
        share = np.bincount(y, minlength=len(self.labels))
        self.nodes.append((-1, 0.0, int(share.argmax()), 0))
        if share.max() == len(y) or not left_depth:
            return at
        best = (np.inf, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v = x[order, f]
            cuts = np.flatnonzero(v[1:] != v[:-1])
            if not len(cuts):
                continue
            hot = np.cumsum(np.eye(len(self.labels))[y[order]], 0)
            left, right = hot[cuts], hot[-1] - hot[cuts]
            n, m = left.sum(1), right.sum(1)
            cost = n - (left**2).sum(1) / n + m - (right**2).sum(1) / m
            k = int(cost.argmin())
            if cost[k] < best[0] - 1e-9:
                best = (cost[k], f, (v[cuts[k]] + v[cuts[k] + 1]) / 2)
        _, f, bound = best
        if f < 0:
            return at
        below = x[:, f] <= bound
        one = self._grow(x[below], y[below], left_depth - 1)
        two = self._grow(x[~below], y[~below], left_depth - 1)
        self.nodes[at] = (f, bound, one, two)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            f, bound, one, two = self.nodes[node]
            if f < 0:
                out[rows] = one
            elif len(rows):
                below = x[rows, f] <= bound
                stack += [(one, rows[below]), (two, rows[~below])]
        return self.labels[out]
