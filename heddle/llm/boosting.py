"""Gradient-boosted trees on dense features, and isotonic calibration; small and in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of one depth over binned features, for the log loss.

    Trees are full: node i has the children 2i+1 and 2i+2. A row goes right where its bin is
    above the node's. Splits have the largest gain by sums of gradients and Hessians.
    """

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    penalty: float = 2.0
    least: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros(x.shape, int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = []
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            middles = (values[1:] + values[:-1]) / 2
            self.edges.append(middles if len(middles) < self.bins else np.unique(np.quantile(values, cuts)))
        b, p = self.binned(x), np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        score = np.full(len(y), self.base)
        features, width = x.shape[1], self.bins + 1
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            inner = 2**self.depth - 1
            feature, cut, value = np.zeros(inner, int), np.full(inner, width), np.zeros(2 * inner + 1)
            node = np.zeros(len(y), int)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-9)
                for j in range(features):
                    place = (node - first) * width + b[:, j]
                    gs, hs = (np.bincount(place, v, many * width).reshape(many, width) for v in (g, h))
                    gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gr, hr = gt - gl, ht - hl
                    gain = gl**2 / (hl + self.penalty) + gr**2 / (hr + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(hl < self.least) | (hr < self.least)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(many), at]
                    better = top > best
                    best[better] = top[better]
                    feature[first : first + many][better] = j
                    cut[first : first + many][better] = at[better]
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node
            value[:] = -self.rate * np.bincount(leaf, g, len(value)) / (np.bincount(leaf, h, len(value)) + self.penalty)
            score = score + value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        score = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            score += value[node]
        return score


@dataclass
class Isotonic:
    """The nondecreasing step function nearest to labels, by pooling neighbours that decrease;
    linear between the middles of its steps."""

    x: np.ndarray
    y: np.ndarray

    @classmethod
    def fit(cls, raw: np.ndarray, label: np.ndarray) -> Isotonic:
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # sum of x, sum of y, number
        for r, y in zip(raw[order], label[order], strict=True):
            blocks.append([r, y, 1.0])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        return cls(np.array([s / n for s, _, n in blocks]), np.array([t / n for _, t, n in blocks]))

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)
