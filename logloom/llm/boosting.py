"""Gradient-boosted regression trees and their calibration, on small arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Trees of one depth: the feature and the cut of each inner node, the value of each leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 200, depth: int = 4, rate: float = 0.15, bins: int = 32, least: int = 6, ridge: float = 2.0,
    rows: float = 0.6, columns: float = 0.3, robust: float = 0.95, seed: int = 1,
) -> Trees:
    """Trees that lower the squared error of ``y`` round by round, on histograms of each feature.

    Stochastic: each round sees a share of the rows and of the features, drawn from a fixed seed.
    Robust: errors beyond the quantile ``robust`` of all errors count as if they were that large, so
    that wrong labels don't pull the trees.
    """
    n, f = x.shape
    rng = np.random.default_rng(seed)
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T if n else np.zeros((f, bins - 1))
    codes = np.empty((n, f), np.int64)
    for j in range(f):
        codes[:, j] = np.searchsorted(edges[j], x[:, j], side="left")
    base = float(y.mean()) if n else 0.0
    left = y - base
    inner = 2**depth - 1
    feature, cut = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf)
    leaves = np.zeros((rounds, inner + 1))
    k = max(1, round(f * columns))
    for r in range(rounds):
        far = np.quantile(np.abs(left), robust) if n else 0.0
        own = np.sort(rng.choice(f, k, replace=False))
        some = np.sort(rng.choice(n, max(1, round(n * rows)), replace=False))
        seen, target = codes[some][:, own], np.clip(left[some], -far, far)
        flat = seen + np.arange(k) * bins
        node, of = np.zeros(len(some), np.int64), np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            index = (flat + (node * (k * bins))[:, None]).ravel()
            shape = (width, k, bins)
            g = np.bincount(index, np.repeat(target, k), width * k * bins).reshape(shape).cumsum(2)
            c = np.bincount(index, minlength=width * k * bins).reshape(shape).cumsum(2).astype(float)
            gt, ct = g[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (c + ridge) + (gt - g) ** 2 / (ct - c + ridge) - gt**2 / (ct + ridge)
            gain[(c < least) | (ct - c < least)] = 0
            gain = gain[:, :, :-1].reshape(width, -1)
            best = gain.argmax(1)
            where, at = np.divmod(best, bins - 1)
            good = gain[np.arange(width), best] > 1e-9
            feature[r, first : first + width] = own[where]
            cut[r, first : first + width] = np.where(good, edges[own[where], at], np.inf)
            node = 2 * node + ((seen[np.arange(len(some)), where[node]] > at[node]) & good[node])
            of = 2 * of + ((codes[np.arange(n), own[where[of]]] > at[of]) & good[of])
        sums, counts = np.bincount(node, target, inner + 1), np.bincount(node, minlength=inner + 1)
        leaves[r] = rate * sums / (counts + ridge)
        left = left - leaves[r][of]
    return Trees(base, feature, cut, leaves)


@dataclass
class Line:
    """A straight line from predictions to the scale of the labels, kept within its ends."""

    start: float
    slope: float
    low: float
    high: float

    def __call__(self, values: np.ndarray) -> np.ndarray:
        return np.clip(self.start + self.slope * values, self.low, self.high)


def calibrate(pred: np.ndarray, y: np.ndarray, low: float, high: float) -> Line:
    """The rising line by which held-out predictions come nearest to the labels.

    Predictions that don't differ, or that fall as labels rise, tell nothing: then the nearest such line is the labels' mean.
    """
    spread = float(np.var(pred)) if len(pred) else 0.0
    slope = max(0.0, float(np.mean((pred - pred.mean()) * (y - y.mean()))) / spread) if spread > 1e-12 else 0.0
    return Line(float(y.mean() - slope * pred.mean()) if len(y) else 0.0, slope, low, high)


def folds(groups: list, k: int) -> np.ndarray:
    """A fold for each row, so that a group lies in one fold and folds are about even."""
    sizes: dict = {}
    for g in groups:
        sizes[g] = sizes.get(g, 0) + 1
    filled, of = [0] * k, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], str(g))):
        of[g] = filled.index(min(filled))
        filled[of[g]] += sizes[g]
    return np.array([of[g] for g in groups], np.int64)
