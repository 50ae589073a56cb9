"""Rows far from rows: the choices of sequential splitters without a look at every row a step.

Rows lie in the leaves of a k-d tree, leaves in blocks. A row that is taken changes the distance of others only in leaves that
are nearer to it than the farthest of their rows, and these become few as rows are taken. Choices are those of a full scan.
"""

from __future__ import annotations

import numpy as np

#: Leaves of a block, and rows of a leaf at about most.
BLOCK, LEAF = 64, 64
#: Bounds are widened by this share, so that rounding can't hide a row.
SLACK = 1e-9


def squared(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of all rows from a point."""
    d = x - p
    return np.einsum("ij,ij->i", d, d)


class Leaves:
    """Rows in leaves of equal size: ids (leaf, place), len(x) where a place is empty, and the boxes of leaves and blocks."""

    def __init__(self, x: np.ndarray):
        n, width = x.shape
        parts, leaves = [np.arange(n)], 1
        while leaves < BLOCK or leaves * LEAF < n:
            halves = []
            for p in parts:
                if len(p) > 1:
                    own = x[p]
                    k = int(np.argmax(np.ptp(own, axis=0)))
                    p = p[np.argpartition(own[:, k], len(p) // 2)]
                halves += [p[: len(p) // 2], p[len(p) // 2 :]]
            parts, leaves = halves, 2 * leaves
        self.n, size = n, max(1, *map(len, parts))
        self.ids = np.full((leaves, size), n)
        for i, p in enumerate(parts):
            self.ids[i, : len(p)] = p
        self.place = np.zeros((n, 2), np.int64)
        leaf, at = np.nonzero(self.ids < n)
        self.place[self.ids[leaf, at]] = np.stack((leaf, at), axis=1)
        self.x = np.zeros((leaves, size, width))
        self.x[leaf, at] = x[self.ids[leaf, at]]
        empty = (self.ids == n)[:, :, None]
        self.lo, self.hi = np.where(empty, np.inf, self.x).min(axis=1), np.where(empty, -np.inf, self.x).max(axis=1)
        self.blocks = [f(v.reshape(-1, BLOCK, width), axis=1) for f, v in ((np.min, self.lo), (np.max, self.hi))]


def _away(lo: np.ndarray, hi: np.ndarray, p: np.ndarray) -> np.ndarray:
    """At most the squared distances of boxes from a point."""
    d = np.maximum(np.maximum(lo - p, p - hi), 0)
    return (d * d).sum(axis=-1) * (1 - SLACK)


class Nearest:
    """The squared distance of every free row from the nearest of the points added."""

    def __init__(self, leaves: Leaves):
        self.t = leaves
        self.near = np.where(leaves.ids < leaves.n, np.inf, -1.0)
        n = len(leaves.ids)
        self.most, self.first = np.zeros(n), np.zeros(n, np.int64)
        self.block_most, self.block_first = np.zeros(n // BLOCK), np.zeros(n // BLOCK, np.int64)
        self._renew(np.arange(n))

    def _renew(self, leaf: np.ndarray) -> None:
        """The largest distance in leaves and their blocks, and the smallest id that has it."""
        v = self.near[leaf]
        self.most[leaf] = m = v.max(axis=1)
        self.first[leaf] = np.where(v == m[:, None], self.t.ids[leaf], self.t.n).min(axis=1)
        b = np.unique(leaf // BLOCK) if len(leaf) > 1 else leaf // BLOCK
        v = self.most.reshape(-1, BLOCK)[b]
        self.block_most[b] = m = v.max(axis=1)
        self.block_first[b] = np.where(v == m[:, None], self.first.reshape(-1, BLOCK)[b], self.t.n).min(axis=1)

    def add(self, p: np.ndarray) -> None:
        t = self.t
        b = np.flatnonzero(_away(*t.blocks, p) < self.block_most)
        if not len(b):
            return
        leaf = (b[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        leaf = leaf[_away(t.lo[leaf], t.hi[leaf], p) < self.most[leaf]]
        if len(leaf):
            x = t.x[leaf]
            self.near[leaf] = np.minimum(self.near[leaf], squared(x.reshape(-1, x.shape[2]), p).reshape(x.shape[:2]))
            self._renew(leaf)

    def drop(self, row: int) -> None:
        leaf, at = self.t.place[row]
        self.near[leaf, at] = -1
        self._renew(np.array([leaf]))

    def farthest(self) -> int:
        """The free row of largest distance, of equal ones the first."""
        return int(self.block_first[self.block_most == self.block_most.max()].min())


def far_rows(x: np.ndarray) -> np.ndarray:
    """Rows, in order, among which all farthest pairs are: those that may be as far from some box as a pair known to be far."""
    t, i, least = Leaves(x), 0, 0.0
    for _ in range(8):
        d = squared(x, x[i])
        i = int(np.argmax(d))
        least = max(least, float(d[i]) * (1 - SLACK))
    some = np.flatnonzero(t.ids[:, 0] < t.n)

    def reach(lo: np.ndarray, hi: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """Whether a box may hold a row that far from one in any of the boxes."""
        out = np.zeros(len(lo), bool)
        for k in range(len(lo)):
            d = np.maximum(t.hi[boxes] - lo[k], hi[k] - t.lo[boxes])
            out[k] = ((d * d).sum(axis=1) * (1 + SLACK)).max() >= least
        return out

    outer = some[reach(t.lo[some], t.hi[some], some)]
    rows = t.ids[outer].ravel()
    rows = np.sort(rows[rows < t.n])
    return rows[reach(x[rows], x[rows], outer)]


def by_leverage(x: np.ndarray, k: int, ridge: float) -> list[int]:
    """k rows, always that of largest leverage given those taken, of equal ones the first.

    Leverages only fall. So a pool of the largest is enough until its best may be under what the others can still have: their
    largest then, times the largest eigenvalue of the inverse now relative to that then.
    """
    n = len(x)
    inv, taken, free = np.eye(x.shape[1]) / ridge, [], np.ones(n, bool)
    while len(taken) < k:
        left = np.flatnonzero(free)
        score = np.einsum("ij,jk,ik->i", x[left], inv, x[left])
        size = max(512, 2 * int(n**0.5))
        bound = float(np.partition(score, len(score) - size)[len(score) - size]) if len(score) > size else -np.inf
        pool = left[score >= bound]
        own, open_, then = x[pool], np.ones(len(pool), bool), np.linalg.inv(np.linalg.cholesky(inv))
        new = True
        while len(taken) < k and open_.any():
            s = np.where(open_, np.einsum("ij,jk,ik->i", own, inv, own), -1)
            i = int(np.argmax(s))
            if not new and bound > -np.inf and s[i] < bound * float(np.linalg.eigvalsh(then @ inv @ then.T)[-1]) * (1 + 1e-6):
                break
            v = inv @ own[i]
            inv -= np.outer(v, v) / (1 + own[i] @ v)
            open_[i], new = False, False
            taken.append(int(pool[i]))
            free[pool[i]] = False
    return taken
