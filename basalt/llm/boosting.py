"""Histogram gradient-boosted trees for a binary label, flattened into arrays.

Training bins each feature once and grows trees level by level from histograms of gradients. A model is a set
of arrays over the nodes of all trees; scoring walks all rows of a batch down a tree at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Node arrays of all trees. A leaf points at itself, so every row takes ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, penalty: float = 1.0) -> Trees:
    """``x``: rows by features; ``y``: 0 or 1. With one class or no rows the model is that class's share."""
    n, features = x.shape
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    arrays: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    if n >= 2 * least and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(features)]
        codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        flat = codes + np.arange(features) * bins
        raw = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            raw += _grow(arrays, roots, flat, codes, edges, p - y, p * (1 - p), depth, rate, bins, least, penalty)
    order = {k: np.array(v, float if k in ("threshold", "value") else np.int64) for k, v in arrays.items()}
    return Trees(**order, roots=np.array(roots, np.int64), depth=depth, base=base)


def _grow(arrays, roots, flat, codes, edges, g, h, depth, rate, bins, least, penalty) -> np.ndarray:
    n, features = codes.shape

    def node() -> int:
        at = len(arrays["feature"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", 0.0)):
            arrays[k].append(v)
        return at

    root = node()
    roots.append(root)
    where = np.full(n, root)
    level = [root]
    for _ in range(depth):
        following = []
        for at in level:
            rows = np.flatnonzero(where == at)
            if len(rows) < 2 * least:
                continue
            index = flat[rows].ravel()
            hist = [np.bincount(index, np.repeat(w, features), features * bins).reshape(features, bins).cumsum(1) for w in (g[rows], h[rows], np.ones(len(rows)))]
            gl, hl, nl = (x[:, :-1] for x in hist)
            gt, ht, nt = (x[:, -1:] for x in hist)
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain[(nl < least) | (nt - nl < least)] = -np.inf
            f, b = divmod(int(np.argmax(gain)), bins - 1)
            if not gain[f, b] > 1e-6 or b >= len(edges[f]):
                continue
            left, right = node(), node()
            arrays["feature"][at], arrays["threshold"][at] = f, float(edges[f][b])
            arrays["left"][at], arrays["right"][at] = left, right
            down = codes[rows, f] <= b
            where[rows] = np.where(down, left, right)
            following += [left, right]
        level = following
    step = np.zeros(n)
    for at in np.unique(where):
        rows = where == at
        value = -rate * g[rows].sum() / (h[rows].sum() + penalty)
        arrays["value"][at] = float(value)
        step[rows] = value
    return step
