"""Gradient-boosted trees on a bounded sample, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np

#: Histogram bins of a feature.
BINS = 32


class Trees:
    """Binary classifier: logistic loss, complete trees of one depth, histogram splits. fit() holds one sample in memory."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.start = 0.0
        #: For each tree: features and cuts of its inner nodes in level order, values of its leaves.
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        share = (y.sum() + 0.5) / (n + 1)
        self.start = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]) if n else np.zeros((width, 0), int)
        raw = np.full(n, self.start)
        for _ in range(self.rounds if 0 < y.sum() < n else 0):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, int)
            feature, cut = [], []
            for level in range(self.depth):
                size = 1 << level
                best, of, at = np.full(size, 1e-9), np.zeros(size, int), np.full(size, np.inf)
                where = np.full(size, BINS)
                for j in range(width):
                    if not len(cuts[j]):
                        continue
                    key = node * BINS + binned[j]
                    gs = np.bincount(key, g, size * BINS).reshape(size, BINS).cumsum(1)
                    hs = np.bincount(key, h, size * BINS).reshape(size, BINS).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    gain[:, len(cuts[j]) :] = 0
                    b = gain.argmax(1)
                    better = gain[np.arange(size), b] > best
                    best[better], of[better], where[better] = gain[np.arange(size), b][better], j, b[better]
                    at[better] = cuts[j][b[better]]
                feature.extend(of)
                cut.extend(at)
                node = 2 * node + (binned[of[node], np.arange(n)] > where[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
            self.trees.append((np.array(feature), np.array(cut), value))
            raw += value[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += value[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the calibration from raw scores to shares of positives, by pooling adjacent violators; between the
    mean raw scores of two blocks the calibration is linear."""
    if not len(raw):
        return np.zeros(1), np.zeros(1)
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of raw
    values, firsts, counts = np.unique(raw[order], return_index=True, return_counts=True)
    sums = np.add.reduceat(y[order].astype(float), firsts)
    for v, s, c in zip(values, sums, counts, strict=True):
        blocks.append([float(s), float(c), float(v * c)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, c2, r2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + c2, blocks[-1][2] + r2]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]
