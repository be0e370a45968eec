"""An R-tree over count vectors, searched with the bound that overlap is at most the sum of coordinate minima."""

from __future__ import annotations

import numpy as np

LEAF, FANOUT = 32, 8


class CountTree:
    """Points are counts of a set's tokens by group; ``num/den`` is the similarity that a pair must reach.

    Built by halving at the median of the widest coordinate until nodes are small (bulk loading); a node keeps the
    largest coordinates and the range of set sizes below it.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.points, self.sizes, self.num, self.den = points, sizes, num, den
        order, leaves = [], []
        stack = [np.argsort(sizes, kind="stable")]
        while stack:
            at = stack.pop()
            if len(at) <= LEAF:
                leaves.append((len(order), len(order) + len(at)))
                order.extend(at)
                continue
            spread = points[at].max(axis=0).astype(np.int64) - points[at].min(axis=0)
            by = sizes[at] if sizes[at].max() > 1.2 * sizes[at].min() else points[at, int(spread.argmax())]
            at = at[np.argsort(by, kind="stable")]
            stack += [at[len(at) // 2 :], at[: len(at) // 2]]
        self.order = np.array(order, dtype=np.int64)
        self.levels = []  # from the leaves up: start, end, top coordinates, least and most size
        spans = leaves
        p, n = points[self.order], sizes[self.order]
        if spans:
            s, e = np.array(spans).T
            tops, lo, hi = np.maximum.reduceat(p, s, axis=0), np.minimum.reduceat(n, s), np.maximum.reduceat(n, s)
            self.levels.append((s, e, tops, lo, hi))
            while len(s) > FANOUT:
                cut = np.arange(0, len(s), FANOUT)
                s, e = cut, np.append(cut[1:], len(s))
                tops, lo, hi = np.maximum.reduceat(tops, s, axis=0), np.minimum.reduceat(lo, s), np.maximum.reduceat(hi, s)
                self.levels.append((s, e, tops, lo, hi))

    def _may(self, q, n, tops, lo, hi) -> np.ndarray:
        """Whether anything under a node (or a point, lo = hi) can reach the similarity."""
        size = (hi * self.den >= n * self.num) & (n * self.den >= lo * self.num)
        least = np.maximum(lo, -(-n * self.num // self.den))
        bound = np.minimum(tops, q).sum(axis=1, dtype=np.int64)
        return size & (bound * (self.num + self.den) >= self.num * (least + n))

    def search(self, q: np.ndarray, n: int) -> np.ndarray:
        """Indices of the points that the bound can't exclude."""
        if not self.levels:
            return np.empty(0, np.int64)
        at = np.arange(len(self.levels[-1][0]))
        for s, e, tops, lo, hi in reversed(self.levels):
            at = at[self._may(q, n, tops[at], lo[at], hi[at])]
            if not len(at):
                return at
            at = np.concatenate([np.arange(a, b) for a, b in zip(s[at], e[at], strict=True)])
        at = self.order[at]
        z = self.sizes[at]
        return at[self._may(q, n, self.points[at], z, z)]


class Labels:
    """Union of indices with labels in one array; the smallest index names a class."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> None:
        names = np.unique(np.append(self.of[others], self.of[a]))
        self.of[np.isin(self.of, names)] = names[0]
