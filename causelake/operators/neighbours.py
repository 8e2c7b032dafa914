"""Exact nearest points in a scaled Euclidean distance: a tree of boxes, searched in numpy for many rows at once."""

from __future__ import annotations

import numpy as np

#: Points of a leaf, at most; rows searched at once; (row, box) pairs held at once (more: the rows are halved).
LEAF = 32
ROWS = 8192
PAIRS = 2_000_000
#: Squared distances are compared to this many decimals, as in SQL; of equal ones the first point stays.
DECIMALS = 15


def levels_of(low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Boxes of all levels, root first, from those of the leaves (a power of two of them)."""
    boxes = [(low, high)]
    while len(low) > 1:
        low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
        boxes.insert(0, (low, high))
    return boxes


def halved(points: np.ndarray, scale: np.ndarray, depth: int) -> np.ndarray:
    """An order of the points in which part ``k`` of ``2 ** depth`` equal ones is a leaf; each cut halves the widest side."""
    n, order = len(points), np.arange(len(points))
    for level in range(depth):
        for k in range(1 << level):
            a, mid, b = n * k >> level, n * (2 * k + 1) >> (level + 1), n * (k + 1) >> level
            held = points[order[a:b]]
            side = int(((held.max(0) - held.min(0)) / scale).argmax())
            order[a:b] = order[a:b][np.argpartition(held[:, side], mid - a)]
    return order


def squares(gap: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Sum of the squared scaled gaps, covariate by covariate."""
    out = (gap[..., 0] / scale[0]) ** 2
    for i in range(1, gap.shape[-1]):
        out += (gap[..., i] / scale[i]) ** 2
    return out


def to_box(x: np.ndarray, low: np.ndarray, high: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Squared distance of rows to boxes, one each."""
    return squares(np.maximum(np.maximum(low - x, x - high), 0.0), scale)


def home(levels: list[tuple[np.ndarray, np.ndarray]], scale: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A leaf near each row: on every level the nearer of two boxes."""
    node = np.zeros(len(x), np.int64)
    for low, high in levels[1:]:
        left, right = 2 * node, 2 * node + 1
        node = np.where(to_box(x, low[right], high[right], scale) < to_box(x, low[left], high[left], scale), right, left)
    return node


def within(levels: list[tuple[np.ndarray, np.ndarray]], scale: np.ndarray, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(row, leaf) of all leaves that may hold a point as near as ``bound``, by row; None if these are too many to hold."""
    reach = bound * (1 + 1e-14) + 10.0**-DECIMALS
    who, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for low, high in levels[1:]:
        if 2 * len(who) > PAIRS and len(x) > 1:
            return None
        who, node = np.repeat(who, 2), np.stack((2 * node, 2 * node + 1), 1).ravel()
        kept = to_box(x[who], low[node], high[node], scale) <= reach[who]
        who, node = who[kept], node[kept]
    return who, node


class Tree:
    """Points in leaves of some ``LEAF``; a point's number is its place in the array given."""

    def __init__(self, points: np.ndarray, scale: np.ndarray):
        n = len(points)
        depth = max(0, -(-n // LEAF) - 1).bit_length()
        order = halved(points, scale, depth)
        ends = n * np.arange((1 << depth) + 1) >> depth
        self.scale, wide = scale, int(np.diff(ends).max())
        at = ends[:-1, None] + np.arange(wide)
        real = at < ends[1:, None]
        self.number = np.where(real, order[np.minimum(at, n - 1)], n)
        self.points = np.where(real[:, :, None], points[np.minimum(self.number, n - 1)], np.inf)
        self.levels = levels_of(np.minimum.reduceat(points[order], ends[:-1]), np.maximum.reduceat(points[order], ends[:-1]))

    def _compare(self, x: np.ndarray, who: np.ndarray, leaf: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        """Betters ``best`` and ``at`` by the leaves' points; ``who`` ascends."""
        step = max(1, PAIRS // self.number.shape[1])
        for i in range(0, len(who), step):
            rows, leaves = who[i : i + step], leaf[i : i + step]
            d = np.round(squares(x[rows][:, None, :] - self.points[leaves], self.scale), DECIMALS)
            least = d.min(1)
            first = np.where(d == least[:, None], self.number[leaves], self.number.size).min(1)
            begins = np.flatnonzero(np.diff(rows, prepend=-1))
            nearest = np.minimum.reduceat(least, begins)
            spread = np.repeat(nearest, np.diff(np.append(begins, len(rows))))
            first = np.minimum.reduceat(np.where(least == spread, first, self.number.size), begins)
            own = rows[begins]
            better = (nearest < best[own]) | ((nearest == best[own]) & (first < at[own]))
            best[own[better]], at[own[better]] = nearest[better], first[better]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest point, squared distance) of each row without missing values; equal rows are searched for once."""
        order = np.lexsort(x.T[::-1])
        new = np.ones(len(x), bool)
        new[1:] = (x[order[1:]] != x[order[:-1]]).any(1)
        once, same = x[order[new]], np.empty(len(x), np.int64)
        same[order] = np.cumsum(new) - 1
        best, at = np.full(len(once), np.inf), np.full(len(once), self.number.size, np.int64)
        for i in range(0, len(once), ROWS):
            self._search(once[i : i + ROWS], best[i : i + ROWS], at[i : i + ROWS])
        return at[same], best[same]

    def _search(self, x: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        own = home(self.levels, self.scale, x)
        self._compare(x, np.arange(len(x)), own, best, at)
        found = within(self.levels, self.scale, x, best)
        if found is None:
            half = len(x) // 2
            self._search(x[:half], best[:half], at[:half])
            self._search(x[half:], best[half:], at[half:])
            return
        who, leaf = found
        other = leaf != own[who]
        self._compare(x, who[other], leaf[other], best, at)
