"""Gradient-boosted trees and isotonic calibration on small dense samples, in numpy; models are plain arrays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of equal depth. features, cuts: (trees, 2**depth - 1); leaves: (trees, 2**depth)."""

    base: float
    depth: int
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, v in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 3, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Logistic loss, second-order gains over histogram bins at quantiles; ``least``: rows a child needs."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, width), int)
    margin, inner = np.full(n, base), 2**depth - 1
    features, cuts, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h, node = p - y, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            best = np.full(count, 1e-9)
            total_g, total_h = np.bincount(at, g, count), np.bincount(at, h, count)
            for j in range(width):
                if not len(edges[j]):
                    continue
                k = len(edges[j]) + 1
                key = at * k + binned[:, j]
                left_g, left_h, left_n = (np.bincount(key, w, count * k).reshape(count, k).cumsum(axis=1)[:, :-1] for w in (g, h, None))
                right_n = np.bincount(at, minlength=count)[:, None] - left_n
                score = lambda a, b: a * a / (b + l2)
                gain = score(left_g, left_h) + score(total_g[:, None] - left_g, total_h[:, None] - left_h) - score(total_g, total_h)[:, None]
                gain[(left_n < least) | (right_n < least)] = -1
                top = gain.argmax(axis=1)
                value = gain[np.arange(count), top]
                for i in np.flatnonzero(value > best):
                    best[i], features[t, first + i], cuts[t, first + i] = value[i], j, edges[j][top[i]]
            node = 2 * node + 1 + (x[np.arange(n), features[t][node]] > cuts[t][node])
        leaf = node - inner
        leaves[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        margin += leaves[t][leaf]
    return Trees(base, depth, features, cuts, leaves)


@dataclass
class Isotonic:
    """A step-wise linear, never falling map from margins to probabilities."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators. Without rows everything is 0; a pseudo-row of each class keeps values off 0 and 1."""
    if not len(y):
        return Isotonic(np.zeros(1), np.zeros(1))
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    prior = float(y.mean())
    s, n, m = np.array(blocks).T
    return Isotonic(m / n, np.maximum.accumulate((s + prior) / (n + 1)))


def out_of_fold(x: Callable[[int], np.ndarray], y: np.ndarray, fold: np.ndarray, **options) -> np.ndarray:
    """Each row's margin from trees that haven't seen its fold; ``x(fold)`` are all rows' features as made without it."""
    out = np.zeros(len(y))
    for f in np.unique(fold).tolist():
        rows = x(f)
        out[fold == f] = fit_trees(rows[fold != f], y[fold != f], **options).margin(rows[fold == f])
    return out
