"""Clusters by density in one window, over cells so small that all of a cell's points are near each other."""

from __future__ import annotations

import numpy as np

#: Side of a cell by eps: a little less than a half of the square's diagonal asks for.
SHARE = 0.7071
_OFFSETS = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
_CHUNK = 1_000_000


def merged(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0..n-1 that each reaches over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new[label]


class Cells:
    """Points sorted by cell: order, the cell of each sorted point, and where each cell begins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, side: float):
        cx, cy = np.floor(x / side).astype(np.int64), np.floor(y / side).astype(np.int64)
        self.order = np.lexsort((cy, cx))
        cx, cy = cx[self.order], cy[self.order]
        new = np.r_[True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])] if len(cx) else np.zeros(0, bool)
        self.start = np.r_[np.flatnonzero(new), len(cx)]
        self.of = np.cumsum(new) - 1
        self.cx, self.cy = cx[new], cy[new]
        self.key = (self.cx << 32) + self.cy
        self.count = np.diff(self.start)

    def beside(self, cells: np.ndarray, i: int, j: int) -> np.ndarray:
        """The cells at an offset, or -1."""
        want = ((self.cx[cells] + i) << 32) + self.cy[cells] + j
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, at, -1)

    def pairs(self, rows: np.ndarray, cells: np.ndarray):
        """Chunks of all pairs (place in rows, sorted point) of each row with the points of its cell."""
        count = self.count[cells]
        ends = np.cumsum(count)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHUNK, "right")))
            n = count[at:to]
            one = np.repeat(np.arange(at, to), n)
            yield one, np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[cells[at:to]], n)
            at = to


def clustered(x: np.ndarray, y: np.ndarray, n: np.ndarray, eps: float, least: int, home: tuple[float, float, float, float]) -> dict:
    """Cores, links of cells and borders of a window that holds all places(x, y; n points each) up to 2 eps around home.

    cores: (rows at home, cell of each). links: (cell, cell) of one cluster, seen from here. borders: (row at home that is no
    core, cell with a core within eps). A cell is named by its key, which is the same in every window.
    """
    grid = Cells(x, y, eps * SHARE)
    x, y, n, cell = x[grid.order], y[grid.order], n[grid.order], grid.of
    weight = np.add.reduceat(n, grid.start[:-1]) if len(n) else np.zeros(0, np.int64)
    near = lambda a, b: (x[a] - x[b]) * (x[a] - x[b]) + (y[a] - y[b]) * (y[a] - y[b]) <= eps * eps
    x0, y0, x1, y1 = home
    inside = (x >= x0) & (x < x1) & (y >= y0) & (y < y1)
    around = (x >= x0 - eps) & (x <= x1 + eps) & (y >= y0 - eps) & (y <= y1 + eps)

    core = weight[cell] >= least
    thin = np.flatnonzero(~core & around)
    have = np.zeros(len(x), np.int64)
    for i, j in _OFFSETS:
        other = grid.beside(cell[thin], i, j)
        rows, other = thin[other >= 0], other[other >= 0]
        for one, two in grid.pairs(rows, other):
            hit = near(rows[one], two)
            have += np.bincount(rows[one[hit]], n[two[hit]], len(x)).astype(np.int64)
    core |= have >= least
    core &= around

    # cells of cores, linked where two cores are within eps: tried first with those that lie furthest towards each other
    who = np.flatnonzero(core)
    cores = Cells(x[who], y[who], eps * SHARE)  # who is sorted by cell already
    links_a, links_b, open_a, open_b = [], [], [], []
    every = np.arange(len(cores.key))
    for i, j in _OFFSETS:
        if (i, j) <= (0, 0):
            continue
        b = cores.beside(every, i, j) if len(every) else every
        a, b = every[b >= 0], b[b >= 0]
        if not len(a):
            continue
        by = np.lexsort((i * x[who] + j * y[who], cores.of))
        hit = near(who[by[cores.start[a + 1] - 1]], who[by[cores.start[b]]])
        links_a.append(a[hit]), links_b.append(b[hit])
        open_a.append(a[~hit]), open_b.append(b[~hit])
    joined = lambda: merged(len(every), np.concatenate([*links_a, every[:0]]), np.concatenate([*links_b, every[:0]]))
    label = joined()
    for a, b in zip(open_a, open_b, strict=True):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        rows = np.repeat(np.arange(len(a)), cores.count[a])
        mine = np.arange(len(rows)) - np.repeat(np.cumsum(cores.count[a]) - cores.count[a], cores.count[a]) + np.repeat(cores.start[a], cores.count[a])
        met = np.zeros(len(a), bool)
        for one, two in cores.pairs(rows, b[rows]):
            met[rows[one[near(who[mine[one]], who[two])]]] = True
        if met.any():
            links_a.append(a[met]), links_b.append(b[met])
            label = joined()

    rim = np.flatnonzero(~core & inside)
    found = [np.zeros((0, 2), np.int64)]
    for i, j in _OFFSETS:
        other = grid.beside(cell[rim], i, j) if len(rim) else rim
        rows, other = rim[other >= 0], other[other >= 0]
        for one, two in grid.pairs(rows, other):
            hit = core[two] & near(rows[one], two)
            found.append(np.unique(np.c_[rows[one[hit]], cell[two[hit]]], axis=0))
    found = np.concatenate(found)
    own = np.flatnonzero(core & inside)
    return {
        "cores": (grid.order[own], grid.key[cell[own]]), "links": (cores.key, cores.key[label]), "borders": (grid.order[found[:, 0]], grid.key[found[:, 1]]),
    }
