"""Clustering features in a tree: what BIRCH keeps of many points.

A feature is the number of points, their mean and the sum of squared deviations, which merge
exactly. A tree takes a point to the nearest feature, level by level; there it joins it if the
merged radius (root mean squared deviation) stays within the threshold, else it is a feature of
its own. Nodes hold BRANCHES entries and split around their two farthest ones. A tree with too
many features is built anew from them with a greater threshold, so that its size is bounded
whatever it is fed; features of several trees are fed to another one in the same way.
"""

from __future__ import annotations

import numpy as np

BRANCHES = 32
MOST_FEATURES = 2_000


class _Node:
    def __init__(self, size: int, leaf: bool):
        self.n, self.mean, self.s = np.zeros(BRANCHES + 1), np.zeros((BRANCHES + 1, size)), np.zeros(BRANCHES + 1)
        self.held, self.below = 0, None if leaf else [None] * (BRANCHES + 1)

    def nearest(self, mean: np.ndarray) -> int:
        return int(((self.mean[: self.held] - mean) ** 2).sum(1).argmin())

    def put(self, at: int, n: float, mean: np.ndarray, s: float, below: _Node | None = None) -> None:
        self.n[at], self.mean[at], self.s[at] = n, mean, s
        if self.below is not None:
            self.below[at] = below
        self.held = max(self.held, at + 1)

    def total(self) -> tuple[float, np.ndarray, float]:
        n = self.n[: self.held]
        mean = n @ self.mean[: self.held] / n.sum()
        return float(n.sum()), mean, float(self.s[: self.held].sum() + n @ ((self.mean[: self.held] - mean) ** 2).sum(1))


def merged(n: float, mean: np.ndarray, s: float, n2: float, mean2: np.ndarray, s2: float) -> tuple[float, np.ndarray, float]:
    gap = mean2 - mean
    return n + n2, mean + gap * (n2 / (n + n2)), s + s2 + n * n2 / (n + n2) * float(gap @ gap)


class Tree:
    def __init__(self, size: int, threshold: float, most: int = MOST_FEATURES):
        self.size, self.threshold, self.most = size, threshold, most
        self.root, self.features = _Node(size, True), 0

    def add(self, n: float, mean: np.ndarray, s: float) -> None:
        path, node = [], self.root
        while node.below is not None:
            at = node.nearest(mean)
            path.append((node, at))
            node = node.below[at]
        if node.held:
            at = node.nearest(mean)
            both = merged(node.n[at], node.mean[at], node.s[at], n, mean, s)
            if both[2] <= both[0] * self.threshold**2:
                node.put(at, *both)
                for up, k in path:
                    up.put(k, *merged(up.n[k], up.mean[k], up.s[k], n, mean, s), up.below[k])
                return
        node.put(node.held, n, mean, s)
        self.features += 1
        for up, k in path:
            up.put(k, *merged(up.n[k], up.mean[k], up.s[k], n, mean, s), up.below[k])
        while node.held > BRANCHES:
            one, two = self._split(node)
            if path:
                up, k = path.pop()
            else:
                up, k = _Node(self.size, False), 0
                self.root = up
            up.put(k, *one.total(), one)
            up.put(up.held, *two.total(), two)
            node = up
        if self.features > self.most:
            self._rebuild()

    def _split(self, node: _Node) -> tuple[_Node, _Node]:
        """The entries nearer to one and to the other of two far ones."""
        x = node.mean[: node.held]
        a = int(((x - x[0]) ** 2).sum(1).argmax())
        away_a = ((x - x[a]) ** 2).sum(1)
        b = int(away_a.argmax())
        to_b = ((x - x[b]) ** 2).sum(1) < away_a
        if a == b or to_b.all() or not to_b.any():
            to_b = np.arange(node.held) % 2 == 1
        out = []
        for side in (~to_b, to_b):
            new = _Node(self.size, node.below is None)
            for k in np.flatnonzero(side).tolist():
                new.put(new.held, node.n[k], node.mean[k], node.s[k], None if node.below is None else node.below[k])
            out.append(new)
        return out[0], out[1]

    def _rebuild(self) -> None:
        """The same features with a greater threshold: at least the least merge of a feature with its neighbour."""
        n, mean, s = self.leaves()
        gaps = ((mean[1:] - mean[:-1]) ** 2).sum(1) * n[1:] * n[:-1] / (n[1:] + n[:-1])
        radius = np.sqrt((gaps + s[1:] + s[:-1]) / (n[1:] + n[:-1]))
        again = Tree(self.size, max(self.threshold * 1.5, float(np.quantile(radius, 0.1)), 1e-12), self.most)
        for row in zip(n, mean, s, strict=True):
            again.add(*row)
        self.root, self.features, self.threshold = again.root, again.features, again.threshold

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, means and squared deviations of all features, neighbours by the tree together."""
        todo, out = [self.root], []
        while todo:
            node = todo.pop()
            if node.below is None:
                out.append(node)
            else:
                todo += reversed(node.below[: node.held])
        return tuple(np.concatenate([getattr(x, name)[: x.held] for x in out]) for name in ("n", "mean", "s"))
