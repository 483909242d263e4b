"""Near pairs of fingerprints by vantage-point trees over many shards at once, in numpy.

A node of a tree is a run of points. Its first point is the vantage point; the others are ordered by their Hamming distance from it and split in
the middle into a near and a far branch. A pair within the radius either includes the vantage point, or lies in one branch, or has a
point in each: then the triangle inequality bounds the two distances from the vantage point to a difference of the radius, so that only the
overlap of the branches at their boundary is compared. All nodes of a level are handled together. Pairs that are known to be connected, by
``Forest``, are not compared, and a branch that is connected as a whole is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs that are compared at a time.
PAIRS = 1 << 20


class Forest:
    """Connected places: ``root`` has the smallest known place of each one's component."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):  # hook the larger root to the smaller, then shorten all paths
            ra, rb = root[a], root[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                new = root[root]
                if (new == root).all():
                    break
                root[:] = new

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of a spanning forest, as two arrays of places."""
        own = np.flatnonzero(self.root != np.arange(len(self.root)))
        return own, self.root[own]


def distance(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the points (n x words) at ``a`` and ``b``."""
    return np.bitwise_count(points[a] ^ points[b]).sum(axis=1, dtype=np.int32)


class Pruning:
    """How many of the pairs in shards were compared."""

    def __init__(self) -> None:
        self.all = self.compared = 0


def _within(points: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, first_radius: int | None, forest: Forest | None, seen: Pruning | None) -> tuple[np.ndarray, ...]:
    """(a, b, distance) of the pairs that are within the radius and not known to be connected."""
    if forest is not None:
        apart = forest.root[a] != forest.root[b]
        a, b = a[apart], b[apart]
    if seen is not None:
        seen.compared += len(a)
    if first_radius is not None:
        close = np.bitwise_count(points[a, 0] ^ points[b, 0]) <= first_radius
        a, b = a[close], b[close]
    d = distance(points, a, b)
    hit = d <= radius
    return a[hit], b[hit], d[hit]


def near_pairs(points: np.ndarray, firsts: np.ndarray, radius: int, forest: Forest | None = None, first_radius: int | None = None, seen: Pruning | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, distance) of places within ``radius`` in the same shard, in parts; each pair once, but for those that ``forest`` connects.

    ``points`` is n x words; shards are runs that begin at ``firsts``. ``first_radius`` excludes pairs by their first word alone.
    """
    at = np.arange(len(points))  # the places, in the order of the nodes
    begin = np.asarray(firsts, np.int64)
    size = np.diff(np.r_[begin, len(points)])
    if seen is not None:
        seen.all += int((size * (size - 1) // 2).sum())
    while True:
        live = size > 1
        begin, size = begin[live], size[live]
        if forest is not None and len(begin):  # a node whose points are all connected has nothing to tell
            node = np.repeat(np.arange(len(begin)), size)
            every = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(len(node))
            other = forest.root[at[every]] != np.repeat(forest.root[at[begin]], size)
            live = np.bincount(node[other], minlength=len(begin)) > 0
            begin, size = begin[live], size[live]
        if not len(begin):
            return
        rest = size - 1
        node = np.repeat(np.arange(len(begin)), rest)
        inside = np.arange(len(node)) - np.repeat(np.cumsum(rest) - rest, rest)
        own = at[begin[node] + 1 + inside]
        vantage = at[begin[node]]
        away = np.empty(len(own), np.int64)
        for i in range(0, len(own), PAIRS):
            away[i : i + PAIRS] = distance(points, own[i : i + PAIRS], vantage[i : i + PAIRS])
        if seen is not None:
            seen.compared += len(own)
        hit = away <= radius
        yield vantage[hit], own[hit], away[hit]
        order = np.lexsort((away, node))
        own, away = own[order], away[order]
        at[begin[node] + 1 + inside] = own
        # the near branch has the first half; pairs across the middle differ by the radius at most in their distance
        half = (rest + 1) // 2
        key = node * (1 << 20) + away
        far = inside >= half[node]
        start = np.cumsum(rest) - rest
        low = np.maximum(np.searchsorted(key, key[far] - radius), start[node[far]])
        room = np.maximum(start[node[far]] + half[node[far]] - low, 0)
        who = np.flatnonzero(far)
        total = np.cumsum(room)
        i = 0
        while i < len(who):
            stop = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, side="right")))
            n = room[i:stop]
            b = np.repeat(who[i:stop], n)
            a = np.repeat(low[i:stop] - (np.cumsum(n) - n), n) + np.arange(len(b))
            yield _within(points, own[a], own[b], radius, first_radius, forest, seen)
            i = stop
        begin, size = np.concatenate([begin + 1, begin + 1 + half]), np.concatenate([half, rest - half])
