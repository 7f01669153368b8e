"""Gradient-boosted trees on numpy arrays: histogram splits, logistic loss, monotone features.

A fitted model is five flat arrays over all nodes of all trees, so scoring is a few gathers a level
for a whole batch, and the model travels to tasks as a few kilobytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """`feature` is -1 at leaves, whose `value` counts; rows with x <= threshold go `left`."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                inner = f >= 0
                go_left = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(inner, np.where(go_left, self.left[node], self.right[node]), node)
            out += self.value[node]
        return out


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """signs[j] is 1 or -1 where the margin must not fall or rise with feature j, else 0.

    A split on such a feature is taken only if its leaf values are in order, and the middle of the
    two bounds what later splits below may give, so whole trees, and their sum, are monotone.
    """
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) if n else np.zeros((0, k), int)
    p0 = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(p0 / (1 - p0)))
    margin = np.full(n, base)
    nodes: list[list] = []
    roots = []

    def weight(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + ridge), lo, hi))

    def gain(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        return -(g * w + 0.5 * (h + ridge) * w * w)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, lo: float, hi: float, level: int) -> int:
        at = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        w = weight(total_g, total_h, lo, hi)
        nodes.append([-1, 0.0, at, at, rate * w])
        if level == depth or len(rows) < 2 * least:
            return at
        best = (1e-6, None)
        here = float(gain(total_g, total_h, np.float64(w)))
        for j in range(k):
            if not len(cuts[j]):
                continue
            b, size = binned[rows, j], len(cuts[j]) + 1
            gl = np.bincount(b, g[rows], size).cumsum()[:-1]
            hl = np.bincount(b, h[rows], size).cumsum()[:-1]
            nl = np.bincount(b, minlength=size).cumsum()[:-1]
            wl = np.clip(-gl / (hl + ridge), lo, hi)
            wr = np.clip(-(total_g - gl) / (total_h - hl + ridge), lo, hi)
            score = gain(gl, hl, wl) + gain(total_g - gl, total_h - hl, wr) - here
            ok = (nl >= least) & (len(rows) - nl >= least) & (signs[j] * (wr - wl) >= 0)
            score = np.where(ok, score, -np.inf)
            i = int(score.argmax())
            if score[i] > best[0]:
                best = (float(score[i]), (j, i, float(wl[i]), float(wr[i])))
        if best[1] is None:
            return at
        j, i, wl, wr = best[1]
        below = binned[rows, j] <= i
        mid = (wl + wr) / 2
        bounds = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[signs[j]]
        nodes[at][:2] = [j, float(cuts[j][i])]
        nodes[at][2] = grow(rows[below], g, h, *bounds[0], level + 1)
        nodes[at][3] = grow(rows[~below], g, h, *bounds[1], level + 1)
        return at

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), -np.inf, np.inf, 0))
        f, t, a, b, v = (np.array(c) for c in zip(*nodes, strict=True))
        margin = margin + Trees(f, t, a, b, v, np.array(roots[-1:]), 0.0, depth).margin(x)
    f, t, a, b, v = (np.array(c) for c in zip(*nodes, strict=True)) if nodes else (np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.zeros(1))
    return Trees(f, t, a, b, v, np.array(roots, int), base, depth)
