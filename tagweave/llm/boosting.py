"""Gradient boosted regression trees for two classes, in numpy: histogram splits, logistic loss, Platt calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 24


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Boosted:
    """Trees as flat arrays over 2^depth - 1 inner nodes and 2^depth leaves; scale and shift calibrate the sum."""

    depth: int
    base: float
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > c[node])
            z += v[node - len(f)]
        return z

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of class 1."""
        return _sigmoid(self.scale * self.raw(x) + self.shift)


def _split(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """The feature and cut with the largest gain; cut inf: none gains."""
    best, where = 1e-6, (0, np.inf)
    total = g.sum() ** 2 / (h.sum() + 1.0)
    for j, c in enumerate(cuts):
        b = np.searchsorted(c, x[:, j])
        gl, hl = np.cumsum(np.bincount(b, g, len(c) + 1))[:-1], np.cumsum(np.bincount(b, h, len(c) + 1))[:-1]
        if not len(gl):
            continue
        gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - total
        k = int(gain.argmax())
        if gain[k] > best:
            best, where = gain[k], (j, float(c[k]))
    return where


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3) -> Boosted:
    """Boosts trees on (x, y); y is 0 or 1."""
    p = np.clip(y.mean(), 0.01, 0.99)
    model = Boosted(depth, float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)))[:-1] for j in range(x.shape[1])]
    z = np.full(len(x), model.base)
    for _ in range(trees):
        p = _sigmoid(z)
        g, h = y - p, p * (1 - p)
        f, c = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(x), np.int64)
        for k in range(2**depth - 1):
            mine = node == k
            if mine.sum() >= 4:
                f[k], c[k] = _split(x[mine], cuts, g[mine], h[mine])
            node[mine] = 2 * k + 1 + (x[mine, f[k]] > c[k])
        at = node - len(f)
        v = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + 1.0)
        z += v[at]
        model.feature.append(f)
        model.cut.append(c)
        model.leaf.append(v)
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, precision: float) -> Boosted:
    """Platt scaling on held-out rows; the threshold is the lowest at which their precision is reached."""
    z = model.raw(x)
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        d = _sigmoid(a * z + b) - t
        w = np.maximum(_sigmoid(a * z + b) * (1 - _sigmoid(a * z + b)), 1e-6)
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([(d * z).sum(), d.sum()]))
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
    model.scale, model.shift = float(a), float(b)
    p = model.probability(x)
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= precision)
    model.threshold = float(max(p[order[good[-1]]], 0.5)) if len(good) else 1.1
    return model
