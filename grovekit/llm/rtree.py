"""An R-tree over vectors of group counts, for overlap search.

The tokens of a set are hashed into groups; the set's point is the vector of its
counts.  Two sets share at most ``sum(min(a_g, b_g))`` tokens, and a set shares
at most ``sum(min(a_g, top_g))`` with any member of a node whose largest counts
are ``top``: that bound prunes whole subtrees.

The tree's coordinates are ``GROUPS`` groups.  Among so few, large sets look
alike, so a large set's point has more groups (``GROUPS`` times a power of two),
of which neighbours add up to the coarser ones, and pairs that the tree can't
rule out are bounded again by the finest groups that both have.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

GROUPS = 128
#: Tokens of a group, at most on average.
TOKENS = 4
FANOUT = 64


def count_vector(tokens: np.ndarray) -> np.ndarray:
    """Tokens (64-bit hashes) by group: their uppermost bits."""
    bits = max(GROUPS.bit_length() - 1, (max(0, len(tokens) - 1) // TOKENS).bit_length())
    return np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)


def coarse(counts: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The same set's counts by fewer groups."""
    return counts if len(counts) == groups else counts.reshape(groups, -1).sum(1, dtype=np.int32)


def packed(counts: np.ndarray) -> bytes:
    """A point in 8 bits a count where that is enough."""
    kind = "<u1" if counts.max(initial=0) < 1 << 8 else "<u4"
    return kind.encode() + counts.astype(kind).tobytes()


def unpacked(points: Sequence[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(p, p[:3].decode(), offset=3).astype(np.int32) for p in points]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """The bound by the finest groups that both have."""
    groups = min(len(a), len(b))
    return int(np.minimum(coarse(a, groups), coarse(b, groups)).sum(dtype=np.int64))


class CountTree:
    """Bulk-loaded: points are ordered by size, then by their heaviest differences, and packed."""

    def __init__(self, fine: Sequence[np.ndarray]):
        self.fine = fine
        points = np.stack([coarse(f) for f in fine]) if len(fine) else np.empty((0, GROUPS), np.int32)
        self.sizes = points.sum(1)
        if points.max(initial=0) < 1 << 15:
            points = points.astype(np.int16)
        if len(points) > FANOUT:
            spread = np.argsort(-points.var(0), kind="stable")[:3]
            self.order = np.lexsort([*(points[:, g] for g in spread), self.sizes // 8])
        else:
            self.order = np.arange(len(points))
        self.points = points[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # top counts, least and largest size, bottom up
        top, low, high = self.points, self.sizes[self.order], self.sizes[self.order]
        while len(top) > 1 or not self.levels and len(top):
            cut = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def search(self, point: np.ndarray, num: int, den: int) -> np.ndarray:
        """Indices of the points that may reach ``den * shared >= num * union`` with ``point``."""
        fine, point = point, coarse(point)
        n, point = int(point.sum()), point.astype(self.points.dtype if point.max(initial=0) < 1 << 15 else np.int32)
        alive = np.zeros(min(1, len(self.points)), np.int64)
        for top, low, high in reversed(self.levels):
            alive = alive[alive < len(top)]
            # shared >= num * (n + m) / (num + den), least for the smallest size m of the node
            bound = np.minimum(top[alive], point).sum(1, dtype=np.int64)
            need = num * (n + low[alive])
            fits = ((num + den) * bound >= need) & (den * high[alive] >= num * n) & (num * low[alive] <= den * n)
            alive = (alive[fits][:, None] * FANOUT + np.arange(FANOUT)).ravel()
        alive = alive[alive < len(self.points)]
        size = self.sizes[self.order[alive]]
        bound = np.minimum(self.points[alive], point).sum(1, dtype=np.int64)
        near = self.order[alive[(num + den) * bound >= num * (n + size)]]
        return near[[(num + den) * _shared(fine, self.fine[i]) >= num * (n + self.sizes[i]) for i in near.tolist()]] if len(near) else near

    def _height(self, height: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The levels, with further roots above up to ``height``."""
        top, low, high = self.levels[-1]
        return self.levels + [(top.max(0, keepdims=True), low[:1], high[:1])] * (height - len(self.levels))

    def join(self, other: CountTree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Yields (i, j, spare) arrays: pairs of points of both trees that may reach ``den * shared >= num * union``, and how far the bound is above that.

        Both sides descend together: pairs of nodes whose bound falls short are
        dropped with all their points, and points are compared leaf by leaf.  A
        tree joined with itself gives each pair once.
        """
        if not self.levels or not other.levels:
            return
        own = self is other
        height = max(len(self.levels), len(other.levels))
        left = right = np.zeros(1, np.int64)  # the roots
        step = np.arange(FANOUT)
        for k, ((top, low, high), (top2, low2, high2)) in enumerate(zip(self._height(height)[::-1], other._height(height)[::-1], strict=True)):
            if k:
                a, b = (left[:, None, None] * FANOUT + step[:, None] + 0 * step).ravel(), (right[:, None, None] * FANOUT + step + 0 * step[:, None]).ravel()
                inside = (a < len(top)) & (b < len(top2))
                if own:
                    inside &= a <= b
                left, right = a[inside], b[inside]
            keep = np.zeros(len(left), bool)
            for at in range(0, len(left), 4096):
                a, b = left[at : at + 4096], right[at : at + 4096]
                bound = np.minimum(top[a], top2[b]).sum(1, dtype=np.int64)
                near = (den * high[a] >= num * low2[b]) & (den * high2[b] >= num * low[a])
                keep[at : at + 4096] = near & ((num + den) * bound >= num * (low[a] + low2[b]))
            left, right = left[keep], right[keep]
        sizes, sizes2 = self.sizes[self.order], other.sizes[other.order]
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            x, y = slice(a * FANOUT, (a + 1) * FANOUT), slice(b * FANOUT, (b + 1) * FANOUT)
            shared = np.minimum(self.points[x][:, None], other.points[y][None]).sum(2, dtype=np.int32)
            spare = (num + den) * shared.astype(np.int64) - num * (sizes[x][:, None] + sizes2[y][None])
            fits = spare >= 0
            if own and a == b:
                fits &= np.tri(*fits.shape, -1, dtype=bool).T
            i, j = np.nonzero(fits)
            if len(i):
                spare = spare[i, j]
                i, j = self.order[i + a * FANOUT], other.order[j + b * FANOUT]
                for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                    if len(self.fine[x]) > GROUPS and len(other.fine[y]) > GROUPS:
                        spare[k] = (num + den) * _shared(self.fine[x], other.fine[y]) - num * (self.sizes[x] + other.sizes[y])
                near = spare >= 0
                if near.any():
                    yield i[near], j[near], spare[near]
