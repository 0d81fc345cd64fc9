"""Gradient-boosted trees for several classes on a bounded table of numbers: histogram splits, softmax loss."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """trees[round][class] = (feature, threshold, left, right, value) arrays; leaves have feature -1."""

    classes: int
    base: np.ndarray | None = None
    rate: float = 0.15
    trees: list = field(default_factory=list)
    temperature: float = 1.0
    shift: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(x), 1))
        for group in self.trees:
            for k, tree in enumerate(group):
                out[:, k] += self.rate * _apply(tree, x)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x) / self.temperature
        return _softmax(s if self.shift is None else s + self.shift)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _apply(tree, x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, value = tree
    node = np.zeros(len(x), np.int64)
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return value[node]
        go = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[node]
        node = np.where(inner, np.where(go, left[node], right[node]), node)


def fit(x: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray | None = None, rounds: int = 40, depth: int = 4, bins: int = 32, rate: float = 0.15, l2: float = 1.0, least: float = 3.0) -> Boosted:
    """y: class numbers. weight: of each row."""
    n, m = x.shape
    w = np.ones(n) if weight is None else weight
    prior = np.array([w[y == k].sum() + 1.0 for k in range(classes)])
    model = Boosted(classes, np.log(prior / prior.sum()), rate)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    s = np.tile(model.base, (n, 1))
    onehot = np.eye(classes)[y]
    offsets = np.arange(m) * bins
    flat = binned + offsets
    for _ in range(rounds):
        p = _softmax(s)
        group = []
        for k in range(classes):
            g, h = (p[:, k] - onehot[:, k]) * w, np.maximum(p[:, k] * (1 - p[:, k]), 1e-6) * w
            tree = _tree(flat, binned, edges, g, h, depth, bins, m, l2, least)
            group.append(tree)
            s[:, k] += rate * _apply(tree, x)
        model.trees.append(group)
    return model


def _tree(flat, binned, edges, g, h, depth, bins, m, l2, least):
    feature, threshold, left, right, value = [], [], [], [], []

    def grow(rows: np.ndarray, d: int) -> int:
        i = len(feature)
        gs, hs = g[rows].sum(), h[rows].sum()
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, -gs / (hs + l2))):
            a.append(v)
        if d == 0 or len(rows) < 2 * least:
            return i
        idx = flat[rows].ravel()
        gh = np.bincount(idx, np.repeat(g[rows], m), m * bins).reshape(m, bins).cumsum(axis=1)
        hh = np.bincount(idx, np.repeat(h[rows], m), m * bins).reshape(m, bins).cumsum(axis=1)
        nn = np.bincount(idx, minlength=m * bins).reshape(m, bins).cumsum(axis=1)
        gain = gh**2 / (hh + l2) + (gs - gh) ** 2 / (hs - hh + l2) - gs**2 / (hs + l2)
        gain[(nn < least) | (len(rows) - nn < least)] = 0
        j, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[j, b] <= 1e-6 or b >= len(edges[j]):
            return i
        go = binned[rows, j] <= b
        feature[i], threshold[i] = int(j), float(edges[j][b])
        left[i] = grow(rows[go], d - 1)
        right[i] = grow(rows[~go], d - 1)
        return i

    grow(np.arange(len(g)), depth)
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, noise: float = 0.02, hold: float = 20.0, steps: int = 300) -> Boosted:
    """Fit a temperature and a shift of each class's score by the likelihood of a holdout, of whose labels a share `noise` may be wrong.

    The shift moves decisions where the scores lean to a kind; `hold` rows' weight of belief keep it small.
    """
    if len(y) < 8:
        return model
    s = model.scores(x)
    rows = np.arange(len(y))

    def loss(t: float, shift: np.ndarray) -> float:
        p = _softmax(s / t + shift)[rows, y]
        return float(-np.log((1 - noise) * p + noise / model.classes).sum() + hold * (shift**2).sum())

    shift = np.zeros(model.classes)
    best = min((loss(t, shift), t) for t in (0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0, 4.0))[1]
    onehot = np.eye(model.classes)[y]
    for _ in range(steps):
        p = _softmax(s / best + shift)
        right = p[rows, y]
        trust = (1 - noise) * right / ((1 - noise) * right + noise / model.classes)
        shift -= (((p - onehot) * trust[:, None]).sum(axis=0) + 2 * hold * shift) / (len(y) + 2 * hold)
    if loss(best, shift) < loss(best, np.zeros(model.classes)):
        model.shift = shift
    model.temperature = best
    return model
