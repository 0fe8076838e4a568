"""Gradient-boosted trees and isotonic calibration, small enough to fit on the driver.

Trees are grown on features cut into at most 64 quantile bins, with logistic loss and second
order gains; they are fitted on a bounded sample, and scoring is array operations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    cuts: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    #: Per tree: feature, bin threshold (left: at or below), left child, right child, value.
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(self.cuts)]) if len(x) else np.zeros((0, len(self.cuts)), int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for f, t, lo, hi, v in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := f[at] >= 0).any():
                go = np.where(b[row, np.maximum(f[at], 0)] <= t[at], lo[at], hi[at])
                at = np.where(inner, go, at)
            out += v[at]
        return out


def _grow(b, g, h, depth, least, l2):
    f, t, lo, hi, v = [], [], [], [], []
    bins = int(b.max()) + 1 if b.size else 1
    stack = [(np.arange(len(b)), depth)]
    todo = [stack[0]]
    f.append(-1), t.append(0), lo.append(0), hi.append(0), v.append(0.0)
    nodes = [0]
    while todo:
        rows, d = todo.pop(0)
        me = nodes.pop(0)
        gs, hs = g[rows].sum(), h[rows].sum()
        v[me] = -gs / (hs + l2)
        if d == 0 or len(rows) < 2 * least:
            continue
        best = (1e-6, -1, 0)
        for j in range(b.shape[1]):
            col = b[rows, j]
            cg, ch, cn = (np.cumsum(np.bincount(col, weights=w, minlength=bins)) for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = cg**2 / (ch + l2) + (gs - cg) ** 2 / (hs - ch + l2) - gs**2 / (hs + l2)
            gain[(cn < least) | (len(rows) - cn < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
        if best[1] < 0:
            continue
        left = b[rows, best[1]] <= best[2]
        f[me], t[me] = best[1], best[2]
        for part, side in ((rows[left], lo), (rows[~left], hi)):
            side[me] = len(f)
            nodes.append(len(f))
            todo.append((part, d - 1))
            f.append(-1), t.append(0), lo.append(0), hi.append(0), v.append(0.0)
    return tuple(np.array(a) for a in (f, t, lo, hi, v))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: int = 5, l2: float = 1.0) -> Trees:
    m = Trees()
    for i in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, i], np.linspace(0, 1, 64)[1:-1])) if len(x) else np.zeros(0)
        m.cuts.append(q)
    p = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 1e-3
    m.base = float(np.log(p / (1 - p)))
    b, z = m.binned(x), np.full(len(y), m.base)
    for _ in range(rounds if len(np.unique(y)) == 2 else 0):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(b, p - y, p * (1 - p), depth, min(least, max(1, len(y) // 10)), l2)
        tree = (*tree[:4], tree[4] * rate)
        m.trees.append(tree)
        one = Trees(m.cuts, 0.0, [tree])
        z += one.margin(x)
    return m


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margin, probability) of the non-decreasing fit, by pooling adjacent violators.

    Each block's probability is shrunk by half a pseudo-count on either side, so that no
    score is exactly 0 or 1.
    """
    if not len(z):
        return np.array([0.0]), np.array([0.5])
    o = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []  # positives, count, lowest and highest margin
    for a, b in zip(z[o].tolist(), y[o].tolist()):
        if blocks and blocks[-1][3] == a:
            blocks[-1][0] += b
            blocks[-1][1] += 1
        else:
            blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, n, _, hi = blocks.pop()
            blocks[-1][0] += p
            blocks[-1][1] += n
            blocks[-1][3] = hi
    knots, values = [], []
    for p, n, a, b in blocks:
        q = (p + 0.5) / (n + 1)
        knots += [a, b]
        values += [q, q]
    return np.array(knots), np.maximum.accumulate(np.array(values))


def calibrated(z: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.interp(z, knots, values)
