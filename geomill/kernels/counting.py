"""Counting boxes that meet, without a list of pairs."""

from __future__ import annotations

import numpy as np

#: So few boxes are compared one with another.
_FEW = 400


def below(u: np.ndarray, v: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each query (p, q) the number of points (u, v) with u < p and v < q: one pass over all of them for each bit of a rank."""
    out = np.zeros(len(p), np.int64)
    if not len(u):
        return out
    line = np.argsort(u, kind="stable")
    high = np.searchsorted(u[line], p, "left")
    values = np.sort(v)
    rank = np.searchsorted(values, v[line], "left")  # equal values have one rank
    want = np.searchsorted(values, q, "left")  # ranks under this count
    low = np.zeros(len(p), np.int64)
    for bit in range(int(len(u)).bit_length() - 1, -1, -1):
        ones = (rank >> bit) & 1
        zero = np.r_[0, np.cumsum(1 - ones)]
        up = ((want >> bit) & 1).astype(bool)
        zl, zh, total = zero[low], zero[high], zero[-1]
        out += np.where(up, zh - zl, 0)
        low, high = np.where(up, total + low - zl, zl), np.where(up, total + high - zh, zh)
        rank = np.concatenate([rank[ones == 0], rank[ones == 1]])
    return out


def meeting(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """How many of the boxes z overlap or touch each of the boxes a: all, less those beside, above and below, with corners once."""
    if not len(a) or not len(z):
        return np.zeros(len(a), np.int64)
    before = [(z[:, 2], a[:, 0]), (-z[:, 0], -a[:, 2])]  # wholly left, wholly right
    under = [(z[:, 3], a[:, 1]), (-z[:, 1], -a[:, 3])]
    out = np.full(len(a), len(z), np.int64)
    for x, p in (*before, *under):
        out -= np.searchsorted(np.sort(x), p, "left")
    for u, p in before:
        for v, q in under:
            out += below(u, v, p, q)
    return out


def met_here(box: np.ndarray, x0: float, y0: float) -> np.ndarray:
    """For each box of a cell how many of the cell's boxes, itself too, it meets so that what both share begins in the cell.

    A common area begins in the cell when one of the two does, by x and by y; x0 and y0 are where the cell begins.
    """
    right, up = box[:, 0] >= x0, box[:, 1] >= y0
    if len(box) <= _FEW:
        low, high = box[:, None, :2], box[None, :, 2:]
        both = (low[..., 0] <= high[..., 0]) & (low[..., 1] <= high[..., 1])
        return (both & both.T & (right[:, None] | right) & (up[:, None] | up)).sum(1)
    out = np.zeros(len(box), np.int64)
    for i in (False, True):
        for j in (False, True):
            ask = (right == i) & (up == j)
            if ask.any():
                out[ask] = meeting(box[ask], box[(i | right) & (j | up)])
    return out
