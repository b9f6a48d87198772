"""BK-trees over 64-bit fingerprints, many at once: children are keyed by their integer distance to the parent."""

from __future__ import annotations

import numpy as np

#: Edge keys of one node; distances are 0 to 64.
WIDTH = 65
#: Pairs of query and node that are looked at together.
FRONTIER = 1 << 20


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """One BK-tree for each run of equal `group` values; fingerprints are distinct within a group."""

    def __init__(self, group: np.ndarray, fps: np.ndarray):
        self.fps = fps
        n = len(fps)
        first = np.ones(n, bool)
        first[1:] = group[1:] != group[:-1]
        starts = np.flatnonzero(first)
        #: The root of each item's own tree.
        self.root = np.repeat(starts, np.diff(np.append(starts, n)))
        keys, kids = [], []
        rest, key = np.arange(n), np.cumsum(first) - 1
        while len(rest):
            first = np.ones(len(rest), bool)
            first[1:] = key[1:] != key[:-1]
            pivots = rest[first]
            if len(rest) < n:
                keys.append(key[first])
                kids.append(pivots)
            at = np.cumsum(first) - 1
            others = ~first
            node = pivots[at[others]]
            rest = rest[others]
            key = node * WIDTH + _distance(fps[rest], fps[node])
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        kids = np.concatenate(kids) if kids else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        #: Children by node and edge: those of one node within a range of distances are one slice.
        self.keys, self.kids = keys[order], kids[order]

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int):
        """Yield (query places, nodes) at most `radius` apart; only edges that may lead to such nodes are followed."""
        for start in range(0, len(queries), FRONTIER // 8):
            todo = [(np.arange(start, min(start + FRONTIER // 8, len(queries))), roots[start : start + FRONTIER // 8])]
            while todo:
                q, node = todo.pop()
                if len(q) > FRONTIER:
                    todo.append((q[FRONTIER:], node[FRONTIER:]))
                    q, node = q[:FRONTIER], node[:FRONTIER]
                d = _distance(queries[q], self.fps[node])
                hit = d <= radius
                yield q[hit], node[hit]
                low = np.searchsorted(self.keys, node * WIDTH + np.maximum(d - radius, 0))
                high = np.searchsorted(self.keys, node * WIDTH + np.minimum(d + radius, WIDTH - 1), side="right")
                n = high - low
                if n.any():
                    total = int(n.sum())
                    at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                    todo.append((np.repeat(q, n), self.kids[at]))


class Union:
    """Connected components of 0..n-1 under arrays of links, which can be added bit by bit."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            pa, pb = self.parent[a], self.parent[b]
            open_ = pa != pb
            if not open_.any():
                return
            a, b, pa, pb = a[open_], b[open_], pa[open_], pb[open_]
            np.minimum.at(self.parent, np.maximum(pa, pb), np.minimum(pa, pb))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up
