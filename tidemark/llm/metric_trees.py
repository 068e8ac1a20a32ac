"""Anchors-hierarchy metric trees: balls of integer points with cached counts and sums.

A tree is built from the middle out. About sqrt(n) anchors take the points that
are nearest to them; each anchor's points become a tree of their own the same
way, and the anchors' balls are merged in pairs, the smallest joint ball first.
Points are put in tree order, so a ball is a range of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 24
# Whole numbers up to here are exact in doubles.
EXACT = 1 << 52


@dataclass
class Tree:
    """``lo, hi``: each ball's range of ordered points; ``left, right``: its parts, -1 for a leaf; the root is the last ball."""

    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    def to_bytes(self) -> list[bytes]:
        return [a.tobytes() for a in (self.order, self.lo, self.hi, self.left, self.right, self.radius, self.sums)]

    @classmethod
    def from_bytes(cls, parts: list[bytes], dim: int) -> Tree:
        kinds = [np.int32] * 5 + [np.float64, np.int64]
        arrays = [np.frombuffer(p, k) for p, k in zip(parts, kinds)]
        return cls(*arrays[:6], arrays[6].reshape(len(arrays[5]), dim))


def _squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    off = points - centre
    return np.einsum("ij,ij->i", off, off)


def _anchors(points: np.ndarray) -> np.ndarray:
    """Each point's anchor. Points of an anchor too near to be nearer to a new one aren't looked at."""
    owner = np.zeros(len(points), np.int64)
    own = _squared(points, points[0])
    at = [0]
    for k in range(1, int(np.ceil(np.sqrt(len(points))))):
        new = int(np.argmax(own))
        if own[new] == 0:
            break
        # d(x, old) <= d(old, new) / 2 leaves x with its old anchor.
        apart = _squared(points[at], points[new])
        near = np.flatnonzero(own > apart[owner] / 4)
        to_new = _squared(points[near], points[new])
        stolen = to_new < own[near]
        taken = near[stolen]
        owner[taken], own[taken] = k, to_new[stolen]
        at.append(new)
    return owner


class _Builder:
    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.whole = points
        self.left, self.right, self.radius, self.sums, self.count, self.leaf = [], [], [], [], [], []

    def _ball(self, index: np.ndarray, left: int, right: int, sums: np.ndarray) -> int:
        centre = sums / len(index)
        self.left.append(left)
        self.right.append(right)
        # A little more than the farthest point, so that rounding can't leave a point outside.
        self.radius.append(float(np.sqrt(_squared(self.points[index], centre).max())) * (1 + 1e-9) + 1e-9)
        self.sums.append(sums)
        self.count.append(len(index))
        self.leaf.append(index if left < 0 else None)
        return len(self.left) - 1

    def grow(self, index: np.ndarray) -> tuple[int, np.ndarray]:
        """The ball of these points and all balls in it."""
        owner = _anchors(self.points[index]) if len(index) > LEAF else np.zeros(1, np.int64)
        if not owner.any():
            return self._ball(index, -1, -1, self.whole[index].sum(0)), index
        parts = [self.grow(index[owner == k]) for k in range(owner.max() + 1) if (owner == k).any()]
        return self._merge(parts)

    def _merge(self, parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
        """Join two balls at a time, those whose joint ball is smallest."""
        n = len(parts)
        centres = np.array([self.sums[b] / self.count[b] for b, _ in parts])
        radius = np.array([self.radius[b] for b, _ in parts])
        joint = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(-1)) + radius[:, None] + radius[None]
        np.fill_diagonal(joint, np.inf)
        for _ in range(n - 1):
            i, j = divmod(int(np.argmin(joint)), n)
            (a, ia), (b, ib) = parts[i], parts[j]
            index = np.concatenate((ia, ib))
            ball = self._ball(index, a, b, self.sums[a] + self.sums[b])
            parts[i] = (ball, index)
            joint[j, :] = joint[:, j] = np.inf
            radius[i] = self.radius[ball]
            centres[i] = self.sums[ball] / self.count[ball]
            alive = np.isfinite(joint[i])
            joint[i, alive] = joint[alive, i] = np.sqrt(_squared(centres[alive], centres[i])) + radius[alive] + radius[i]
            last = i
        return parts[last]


def build(points: np.ndarray) -> Tree:
    """The tree of n > 0 integer points."""
    builder = _Builder(points)
    root, order = builder.grow(np.arange(len(points)))
    n = len(builder.left)
    lo, hi = np.zeros(n, np.int32), np.zeros(n, np.int32)
    todo = [(root, 0)]
    while todo:
        ball, start = todo.pop()
        lo[ball], hi[ball] = start, start + builder.count[ball]
        if builder.left[ball] >= 0:
            todo += [(builder.left[ball], start), (builder.right[ball], start + builder.count[builder.left[ball]])]
    kinds = [np.array(x, np.int32) for x in (builder.left, builder.right)]
    return Tree(order.astype(np.int32), lo, hi, *kinds, np.array(builder.radius), np.array(builder.sums, np.int64).reshape(n, points.shape[1]))


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to integer entries."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(1, points.shape[1]) < EXACT else np.int64
    p, e = points.astype(kind), entries.astype(kind)
    return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)[None]).astype(np.int64)


def assign(tree: Tree, points: np.ndarray, entries: np.ndarray, members: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Sums and counts of the points nearest to each entry; with ``members`` also each point's entry and squared distance.

    Goes down the tree with, for each ball, the list of entries that may still
    be nearest to a point in it. Entry i beats j in a whole ball if it does so by
    more than the ball's reach along their difference; a ball with one entry
    left is owned and gives its cached sum. Only leaves with several entries are
    looked at point by point; ties go to the lower index. ``points`` are in the
    order they were given to ``build``; what comes back is in that order too.
    """
    k, dim = entries.shape
    e = entries.astype(np.float64)
    apart = np.sqrt(((e[:, None] - e[None]) ** 2).sum(-1))
    sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    owner = np.empty(len(points), np.int64) if members else None
    ordered = points[tree.order]
    # Of equal entries only the first can be nearest.
    balls, lists = np.array([len(tree.lo) - 1]), ~np.tril(apart == 0, -1).any(1)[None]
    while len(balls):
        n = tree.hi[balls] - tree.lo[balls]
        centres = tree.sums[balls] / n[:, None]
        far = ((centres[:, None] - e[None]) ** 2).sum(-1)
        best = np.where(lists, far, np.inf).argmin(1)
        lead = far[np.arange(len(balls)), best][:, None]
        # Rounding may only keep an entry too many.
        slack = 1e-9 * (far + lead) + 1e-6
        lists = lists & (lead - far + 2 * tree.radius[balls][:, None] * apart[best] + slack >= 0)
        lists[np.arange(len(balls)), best] = True
        owned = lists.sum(1) == 1
        np.add.at(sums, best[owned], tree.sums[balls[owned]])
        np.add.at(counts, best[owned], n[owned])
        if members:
            for b, to in zip(balls[owned], best[owned]):
                owner[tree.lo[b] : tree.hi[b]] = to
        leaf = ~owned & (tree.left[balls] < 0)
        if leaf.any():
            size = n[leaf]
            first = np.repeat(tree.lo[balls[leaf]] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
            at = first + np.arange(len(first))
            distance = squared_distances(ordered[at], entries)
            # Entries off the list are farther than some other, so they needn't be left out here.
            to = distance.argmin(1)
            np.add.at(sums, to, ordered[at])
            np.add.at(counts, to, 1)
            if members:
                owner[at] = to
        down = ~owned & ~leaf
        balls = np.concatenate((tree.left[balls[down]], tree.right[balls[down]]))
        lists = np.concatenate((lists[down], lists[down]))
    if not members:
        return sums, counts, None, None
    nearest = np.empty(len(points), np.int64)
    nearest[tree.order] = owner
    off = points.astype(np.int64) - entries[nearest]
    return sums, counts, nearest, (off * off).sum(1)
