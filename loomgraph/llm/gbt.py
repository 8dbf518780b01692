"""Gradient-boosted trees for two classes: logistic loss, histogram splits, second-order leaf values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Arrays by node: feature (-1: leaf), threshold (left if value <= threshold), children, leaf value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            go = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)


@dataclass
class Forest:
    base: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.predict(x)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def sql(self, names: list[str]) -> str:
        """The margin as an SQL expression over the named columns."""

        def node(t: Tree, i: int) -> str:
            if t.feature[i] < 0:
                return f"{t.value[i]:.8f}D"
            return f"if({names[t.feature[i]]} <= {t.threshold[i]:.8f}D, {node(t, t.left[i])}, {node(t, t.right[i])})"

        return " + ".join([f"{self.base:.8f}D", *[node(t, 0) for t in self.trees]])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: int = 8) -> Forest:
    """Fits on rows x (floats) and labels y (0 or 1). Deterministic."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    # thresholds are rounded as sql() prints them, so that both forms decide alike
    cuts = [np.unique(np.round(c, 8)) for c in cuts]
    code = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]) if n else np.zeros((0, width), int)
    p = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    base = round(float(np.log(p / (1 - p))), 8)
    f = np.full(n, base)
    out = []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, q * (1 - q)
        nodes: list[list] = []

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, 0, 0, 0.0])
            sg, sh = g[rows].sum(), h[rows].sum()
            nodes[me][4] = round(float(rate * sg / (sh + l2)), 8)
            if level == depth or len(rows) < 2 * least:
                return me
            best, split = 1e-6, None
            for j in range(width):
                m = len(cuts[j])
                if not m:
                    continue
                c = code[rows, j]
                gl = np.cumsum(np.bincount(c, g[rows], m + 1))[:-1]
                hl = np.cumsum(np.bincount(c, h[rows], m + 1))[:-1]
                nl = np.cumsum(np.bincount(c, minlength=m + 1))[:-1]
                gain = gl**2 / (hl + l2) + (sg - gl) ** 2 / (sh - hl + l2) - sg**2 / (sh + l2)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, split = gain[k], (j, k)
            if split is None:
                return me
            j, k = split
            go = code[rows, j] <= k
            nodes[me][0], nodes[me][1] = j, float(cuts[j][k])
            nodes[me][2] = grow(rows[go], level + 1)
            nodes[me][3] = grow(rows[~go], level + 1)
            return me

        grow(np.arange(n), 0)
        a = list(zip(*nodes))
        t = Tree(np.array(a[0]), np.array(a[1]), np.array(a[2]), np.array(a[3]), np.array(a[4]))
        f += t.predict(x)
        out.append(t)
    return Forest(base, out)


def threshold_for(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score at which the rows scored so high or higher have the precision (1 if there is none)."""
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(np.diff(score[order]) != 0, True)  # rows of equal score stand or fall together
    good = np.flatnonzero((hit >= precision) & last)
    return float(score[order][good[-1]]) if len(good) else 1.0
