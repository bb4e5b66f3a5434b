"""A cover tree over unit vectors in memory, and the dual traversal that finds all pairs within a distance.

A node covers its points within its radius; its children cover them within half of it, and so on. A pair of nodes
whose balls are too far apart is dropped, a pair whose balls are close enough counts as a whole, and only the others
are opened. Bounds keep a margin, so that every pair near the threshold is decided by its cosine alone.
"""

from __future__ import annotations

import numpy as np

LEAF = 24
TILE = 1024
MARGIN = 1e-6
"""Slack of all bounds: distances come from cosines, which rounding moves by less than 1e-7."""

_PENDING = 1 << 20


def distances(cosines: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


def reach(cosine: float) -> float:
    """The distance of unit vectors that have this cosine."""
    return float(np.sqrt(max(2 - 2 * cosine, 0)))


class CoverTree:
    """Nodes of ``points`` (rows of length one). A node's points are ``order[low[node]: high[node]]``."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.center, self.radius, self.low, self.high = [], [], [], []
        self.children: list[list[int]] = []
        if len(points):
            self._add(0, len(points), 0)
        at = 0
        while at < len(self.center):
            self._open(at)
            at += 1
        self.center, self.radius, self.low, self.high = (
            np.array(x) for x in (self.center, self.radius, self.low, self.high))

    def _add(self, low: int, high: int, center: int) -> int:
        own = self.order[low:high]
        far = distances(self.points[own] @ self.points[center]).max() if high - low > 1 else 0.0
        for values, value in ((self.center, center), (self.radius, float(far)), (self.low, low), (self.high, high),
                              (self.children, [])):
            values.append(value)
        return len(self.center) - 1

    def _open(self, node: int) -> None:
        low, high = self.low[node], self.high[node]
        if high - low <= LEAF or self.radius[node] <= MARGIN:
            return
        rest, nets = self.order[low:high].copy(), []
        while len(rest):
            near = distances(self.points[rest] @ self.points[rest[0]]) <= self.radius[node] / 2
            near[0] = True
            nets.append(rest[near])
            rest = rest[~near]
        at = low
        for net in nets:
            self.order[at: at + len(net)] = net
            self.children[node].append(self._add(at, at + len(net), int(net[0])))
            at += len(net)


class Pairs:
    """What a traversal found: for each point the weight of its partners, and the classes that links join."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.found = np.zeros(len(weights), np.int64)
        self.label = np.arange(len(weights))
        self._pending: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def link(self, first: np.ndarray, second: np.ndarray) -> None:
        self._pending.append((first, second))
        self._waiting += len(first)
        if self._waiting > _PENDING:
            self.settle()

    def settle(self) -> np.ndarray:
        """Labels of the classes so far: smallest labels spread over the links, and along labels, until none moves."""
        if self._pending:
            first, second = (np.concatenate(x) for x in zip(*self._pending, strict=True))
            while True:
                a, b = self.label[first], self.label[second]
                low, high = np.minimum(a, b), np.maximum(a, b)
                open_ = low < high
                if not open_.any():
                    break
                np.minimum.at(self.label, high[open_], low[open_])
                while True:
                    further = self.label[self.label]
                    if (further == self.label).all():
                        break
                    self.label = further
            self._pending, self._waiting = [], 0
        return self.label


def traverse(a: CoverTree, b: CoverTree, pairs: Pairs, cosine: float, shift: int = 0) -> None:
    """Adds to ``pairs`` all pairs of a point of ``a`` and one of ``b`` with this cosine at least. ``shift`` is the
    number of the first point of ``b`` among the points of ``pairs``; the pairs of one tree with itself count once."""
    if not len(a.points) or not len(b.points):
        return
    same, limit = a is b, reach(cosine)
    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        left, right = a.children[i] or [i], b.children[j] or [j]
        if left == [i] and right == [j]:
            _compare(a, b, i, j, pairs, cosine, shift, same)
            continue
        left, right = np.array(left), np.array(right)
        for x in range(0, len(left), TILE):
            for y in range(0, len(right), TILE):
                some, others = left[x: x + TILE], right[y: y + TILE]
                far = distances(a.points[a.center[some]] @ b.points[b.center[others]].T)
                slack = a.radius[some][:, None] + b.radius[others][None, :]
                near = far - slack <= limit + MARGIN
                if same and i == j:
                    near &= some[:, None] <= others[None, :]
                    far[some[:, None] == others[None, :]] = 0
                whole = near & (far + slack < limit - MARGIN)
                _join(a, b, *(_pair(whole, some, others)), pairs, shift, same)
                stack += zip(*(z.tolist() for z in _pair(near & ~whole, some, others)), strict=True)


def _pair(which: np.ndarray, some: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, second = np.nonzero(which)
    return some[first], others[second]


def _join(a, b, first, second, pairs: Pairs, shift: int, same: bool) -> None:
    """Pairs of nodes all of whose points are partners."""
    if not len(first):
        return
    pairs.link(a.order[a.low[first]], b.order[b.low[second]] + shift)
    single = (a.high[first] - a.low[first] == 1) & (b.high[second] - b.low[second] == 1)
    if same:
        single &= first != second
    p, q = a.order[a.low[first[single]]], b.order[b.low[second[single]]] + shift
    np.add.at(pairs.found, p, pairs.weights[q])
    np.add.at(pairs.found, q, pairs.weights[p])
    for i, j in zip(first[~single].tolist(), second[~single].tolist(), strict=True):
        p, q = a.order[a.low[i]: a.high[i]], b.order[b.low[j]: b.high[j]] + shift
        if same and i == j:
            pairs.found[p] += pairs.weights[p].sum() - pairs.weights[p]
        else:
            pairs.found[p] += pairs.weights[q].sum()
            pairs.found[q] += pairs.weights[p].sum()
        pairs.link(p, np.broadcast_to(q[:1], len(p)))
        pairs.link(q, np.broadcast_to(p[:1], len(q)))


def _compare(a, b, i: int, j: int, pairs: Pairs, cosine: float, shift: int, same: bool) -> None:
    """Two leaves, point by point. A leaf of more than ``LEAF`` points has equal ones only and is cut in tiles."""
    left, right = a.order[a.low[i]: a.high[i]], b.order[b.low[j]: b.high[j]]
    own = same and i == j
    for x in range(0, len(left), TILE):
        for y in range(x if own else 0, len(right), TILE):
            p, q = left[x: x + TILE], right[y: y + TILE]
            hit = a.points[p] @ b.points[q].T >= cosine
            if own and x == y:
                hit = np.triu(hit, 1)
            q = q + shift
            pairs.found[p] += hit @ pairs.weights[q]
            pairs.found[q] += pairs.weights[p] @ hit
            first, second = np.nonzero(hit)
            pairs.link(p[first], q[second])
