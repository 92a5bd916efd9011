"""Box kernels on arrays, in the order given."""

from __future__ import annotations

import numpy as np

from geomill.kernels.density import merged


def greedy(b: np.ndarray, threshold: float, metric: str) -> np.ndarray:
    """Which boxes stay: each one that stays drives out the later ones that overlap it by the threshold or more."""
    if metric not in ("IOS", "IOU"):
        raise ValueError(f"unknown metric: {metric!r}")
    size = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    keep = np.ones(len(b), bool)
    for i in range(len(b)):
        if keep[i]:
            rest = np.flatnonzero(keep[i + 1 :]) + i + 1
            w = np.minimum(b[i, 2], b[rest, 2]) - np.maximum(b[i, 0], b[rest, 0])
            h = np.minimum(b[i, 3], b[rest, 3]) - np.maximum(b[i, 1], b[rest, 1])
            both = np.maximum(w, 0) * np.maximum(h, 0)
            whole = np.minimum(size[i], size[rest]) if metric == "IOS" else size[i] + size[rest] - both
            keep[rest[both / np.maximum(whole, 1e-10) >= threshold]] = False
    return keep


GONE, ALIVE, UNKNOWN = 0, 1, 2
_CANDIDATES = 1_000_000


def sharing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The area that boxes share."""
    w = np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0])
    return np.maximum(w, 0) * np.maximum(np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]), 0)


class Bins:
    """Boxes by the bin of their lower left corner; a bin is as wide as the widest box, so what touches a box lies in 3 x 3 bins."""

    def __init__(self, box: np.ndarray):
        self.box = box
        low, far = box[:, :2].min(0), box[:, :2].max(0)
        side = float(max((box[:, 2:] - box[:, :2]).max(), (far - low).max() / 1000, 1e-9)) * (1 + 1e-9)
        at = np.floor((box[:, :2] - low) / side).astype(np.int64)
        to = np.floor((box[:, 2:] - low) / side).astype(np.int64)
        nx, ny = at.max(0) + 1
        key = at[:, 0] * ny + at[:, 1]
        self.key = key
        self.rows = np.argsort(key, kind="stable")
        start = np.searchsorted(key[self.rows], np.arange(nx * ny + 1))
        columns = at[:, :1] + np.array([-1, 0, 1])
        below, above = np.maximum(at[:, 1:] - 1, 0), np.minimum(to[:, 1:], ny - 1)
        ok = (columns >= 0) & (columns < nx) & (columns <= to[:, :1])
        columns = np.clip(columns, 0, nx - 1)
        self.low = start[columns * ny + below]
        self.high = np.where(ok, start[columns * ny + above + 1], self.low)
        self.count = (self.high - self.low).sum(1)

    def touching(self, some: np.ndarray, most: int = _CANDIDATES):
        """Pieces of pairs (row of `some`, later row that it touches), for about `most` candidates at a time; a piece tells how far it goes."""
        ends = np.cumsum(self.count[some])
        at = 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield some[at:to], *self._pairs(some[at:to])
            at = to

    def listed(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row with all that stands from low to high in the order of bins."""
        low, n = low.ravel(), (high - low).ravel()
        one = np.repeat(np.repeat(rows, 3), n)
        return one, self.rows[np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]

    def _pairs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = self.listed(rows, self.low[rows], self.high[rows])
        later = two > one
        one, two = one[later], two[later]
        a, b = self.box[one], self.box[two]
        meet = (a[:, 0] <= b[:, 2]) & (b[:, 0] <= a[:, 2]) & (a[:, 1] <= b[:, 3]) & (b[:, 1] <= a[:, 3])
        return one[meet], two[meet]


def _swept(box: np.ndarray, sure: np.ndarray, excludes, meet) -> np.ndarray:
    """States of boxes in their order after each that is not gone has met the later ones that `excludes` pairs it with.

    sure: which boxes have all that they touch in this window; the others may have been taken by what is not here.
    """
    state = np.where(sure, ALIVE, UNKNOWN).astype(np.int8)
    bins = Bins(box)
    at = 0
    while at < len(box):
        rest = at + np.flatnonzero(state[at:] != GONE)
        if not len(rest):
            break
        lot, one, two = next(bins.touching(rest))
        at = int(lot[-1]) + 1
        here = state[two] != GONE
        one, two = one[here], two[here]
        here = excludes(one, two)
        one, two = one[here], two[here]
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        rows, start = np.unique(one, return_index=True)
        for i, j, k in zip(rows.tolist(), start.tolist(), np.r_[start, len(one)][1:].tolist(), strict=True):
            if state[i] != GONE:
                meet(state, i, two[j:k])
    return state


def suppressed(box: np.ndarray, sure: np.ndarray, threshold: float, metric: str) -> np.ndarray:
    """States of boxes that come best first: one that stays drives out what it excludes."""
    size = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])

    def excludes(a, b):
        both = sharing(box[a], box[b])
        whole = np.minimum(size[a], size[b]) if metric == "IOS" else size[a] + size[b] - both
        return both / np.maximum(whole, 1e-10) >= threshold

    def meet(state, i, others):
        if state[i] == ALIVE:
            state[others] = GONE
        else:
            state[others[state[others] == ALIVE]] = UNKNOWN

    return _swept(box, sure, excludes, meet)


def joined(box: np.ndarray, threshold: float) -> np.ndarray:
    """The first of the boxes that each is linked to by an IoU over the threshold, over others too.

    Boxes next to each other in their bin are tried first. After that only those outside of the largest group ask, and only
    bins that hold another group than theirs, so a crowd that is one group costs no look at its pairs.
    """
    size = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    bins = Bins(box)

    def linked(label, one, two):
        both = sharing(box[one], box[two])
        whole = size[one] + size[two] - both
        hit = np.divide(both, whole, out=np.zeros(len(one)), where=whole > 0) > threshold
        return merged(len(box), label[one[hit]], label[two[hit]])[label]

    label = np.arange(len(box))
    beside = bins.rows[np.lexsort((box[bins.rows, 0], bins.key[bins.rows]))]
    for k in range(1, min(9, len(box))):
        label = linked(label, beside[:-k], beside[k:])
    todo = np.flatnonzero(label != np.bincount(label).argmax())
    while len(todo):
        own = label[bins.rows]
        change = np.r_[0, np.cumsum(own[1:] != own[:-1])]
        low, high = bins.low[todo], bins.high[todo]
        same = (high <= low) | ((change[np.maximum(high, 1) - 1] == change[np.minimum(low, len(box) - 1)]) & (own[np.minimum(low, len(box) - 1)] == label[todo][:, None]))
        low = np.where(same, high, low)
        take = max(1, int(np.searchsorted(np.cumsum((high - low).sum(1)), _CANDIDATES, "right")))
        one, two = bins.listed(todo[:take], low[:take], high[:take])
        apart = label[one] != label[two]
        label = linked(label, one[apart], two[apart])
        todo = todo[take:]
    return label


def pairwise_drops(box: np.ndarray, sure: np.ndarray, score: np.ndarray, tiles: list[frozenset], of: np.ndarray, threshold: float) -> np.ndarray:
    """States of boxes in their order: of two that exclude each other and share a tile the less sure one goes, the later on ties.

    tiles: sets of tiles, and `of` the one of each box. What is gone drives out no other.
    """
    size = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    common: dict[int, np.ndarray] = {}

    def share(a, b):
        out = np.zeros(len(a), bool)
        for k in np.unique(of[a]).tolist():
            if k not in common:
                common[k] = np.array([not tiles[k].isdisjoint(t) for t in tiles])
            own = of[a] == k
            out[own] = common[k][of[b[own]]]
        return out

    def excludes(a, b):
        both = sharing(box[a], box[b])
        whole = size[a] + size[b] - both
        over = np.divide(both, whole, out=np.zeros(len(a)), where=whole > 0) > threshold
        over[over] = share(a[over], b[over])
        return over

    def meet(state, i, others):
        others = others[state[others] != GONE]
        loses = score[others] > score[i]
        if loses.any():
            known = state[others] == ALIVE
            end = np.flatnonzero(loses & known)
            if len(end):  # here it meets one that takes it for certain
                state_after, others, loses, known = GONE, others[: end[0]], loses[: end[0]], known[: end[0]]
            else:
                state_after = UNKNOWN
            doubt = np.flatnonzero(loses)  # others that take it if they are still there
            first = int(doubt[0]) if state[i] == ALIVE and len(doubt) else (len(others) if state[i] == ALIVE else 0)
            mine = np.arange(len(others))
            state[others[~loses & (mine < first)]] = GONE
            state[others[~loses & (mine >= first) & known]] = UNKNOWN
            state[i] = state_after
        elif state[i] == ALIVE:
            state[others] = GONE
        else:
            state[others[state[others] == ALIVE]] = UNKNOWN

    return _swept(box, sure, excludes, meet)
