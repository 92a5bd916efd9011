"""Relief kernels on a window with NaN where there is no height, from the published definitions."""

from __future__ import annotations

import numpy as np




def _shift(w: np.ndarray, halo: int, dr: int, dc: int) -> np.ndarray:
    n = w.shape[0]
    return w[halo + dr : n - halo + dr, halo + dc : n - halo + dc]


def gradient(w: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Horn's (1981) weighted differences to the east and to the north; a missing neighbour has the cell's own height."""
    z = _shift(w, 1, 0, 0)
    n = {(r, c): np.where(np.isnan(v := _shift(w, 1, r, c)), z, v) for r in (-1, 0, 1) for c in (-1, 0, 1)}
    p = (n[-1, 1] + 2 * n[0, 1] + n[1, 1] - n[-1, -1] - 2 * n[0, -1] - n[1, -1]) / (8 * size)
    q = (n[-1, -1] + 2 * n[-1, 0] + n[-1, 1] - n[1, -1] - 2 * n[1, 0] - n[1, 1]) / (8 * size)
    return p, q


def slope(w: np.ndarray, size: float, percent: bool = False) -> np.ndarray:
    p, q = gradient(w, size)
    rise = np.hypot(p, q)
    return 100 * rise if percent else np.degrees(np.arctan(rise))


def hillshade(w: np.ndarray, size: float, directions: int, elevation: float) -> np.ndarray:
    p, q = gradient(w, size)
    norm = np.sqrt(1 + p * p + q * q)
    e = np.radians(elevation)
    out = np.zeros_like(p)
    for a in 2 * np.pi * np.arange(directions) / directions:
        out += np.maximum(0, (np.sin(e) - np.cos(e) * (p * np.sin(a) + q * np.cos(a))) / norm)
    return out / directions


def _horizon(w: np.ndarray, halo: int, size: float, directions: int, floor: float, nearest: int = 1) -> np.ndarray:
    """Greatest tangent of the elevation angle in each direction from `nearest` cells on within the halo, at least `floor`."""
    z = _shift(w, halo, 0, 0)
    out = np.full((directions, *z.shape), floor)
    for k, a in enumerate(2 * np.pi * np.arange(directions) / directions):
        done = set()
        for d in range(nearest, halo + 1):
            r, c = -int(round(d * np.cos(a))), int(round(d * np.sin(a)))
            if (r, c) in done or not (r or c):
                continue
            done.add((r, c))
            t = (_shift(w, halo, r, c) - z) / (np.hypot(r, c) * size)
            out[k] = np.fmax(out[k], t)
    return out


def sky_view(w: np.ndarray, halo: int, size: float, directions: int, nearest: int = 1) -> np.ndarray:
    """Zaksek, Ostir and Kokalj (2011): one less the mean sine of the horizon."""
    return 1 - np.sin(np.arctan(_horizon(w, halo, size, directions, 0.0, nearest))).mean(0)


def openness(w: np.ndarray, halo: int, size: float, directions: int, nearest: int = 1) -> np.ndarray:
    """Mean zenith angle of the horizon in degrees."""
    return 90 - np.degrees(np.arctan(_horizon(w, halo, size, directions, -np.inf, nearest))).mean(0)


def local_dominance(w: np.ndarray, halo: int, size: float, inner: int, angle: int, height: float) -> np.ndarray:
    """Hesse (2016): how steeply an observer looks down on the surroundings, weighted by distance."""
    z = _shift(w, halo, 0, 0)
    total, weight = np.zeros_like(z), np.zeros_like(z)
    for a in np.radians(np.arange(0, 360, angle)):
        for d in range(inner, halo + 1):
            r, c = -int(round(d * np.cos(a))), int(round(d * np.sin(a)))
            v = _shift(w, halo, r, c)
            dist = np.hypot(r, c) * size
            if dist == 0:
                continue
            share = 2 * np.log(d + 0.5) - 2 * np.log(d - 0.5) if d > 0 else 0.0
            there = ~np.isnan(v)
            total += np.where(there, np.arctan((z + height - v) / dist) * share, 0)
            weight += there * share
    return np.degrees(np.where(weight > 0, total / np.maximum(weight, 1e-12), 0))


def local_relief(w: np.ndarray, halo: int) -> np.ndarray:
    """Height above the mean of the square of the radius (Hesse 2010)."""
    there = ~np.isnan(w)

    def box(v):
        s = np.zeros((v.shape[0] + 1, v.shape[1] + 1))
        s[1:, 1:] = v.cumsum(0).cumsum(1)
        k = 2 * halo + 1
        return s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]

    return _shift(w, halo, 0, 0) - box(np.where(there, w, 0.0)) / np.maximum(box(there.astype(float)), 1)


#: Fixed values by type of terrain (general, flat, steep): sun elevation, greatest slope, range of openness, range of sky view.
TERRAINS = (
    {"sun": 35.0, "slope": 50.0, "open": (68.0, 93.0), "sky": (0.7, 1.0)},
    {"sun": 15.0, "slope": 15.0, "open": (85.0, 91.0), "sky": (0.9, 1.0)},
    {"sun": 55.0, "slope": 60.0, "open": (55.0, 95.0), "sky": (0.55, 1.0)},
)


def blend(w: np.ndarray, halo: int, size: float, terrain: dict = TERRAINS[0]) -> np.ndarray:
    """After Kokalj and Somrak (2019): sky view multiplied in, then openness, slope and hillshade over each other."""

    def share(x, low, high):
        return np.clip((x - low) / (high - low), 0, 1)

    near = w[halo - 1 : w.shape[0] - halo + 1, halo - 1 : w.shape[1] - halo + 1]
    shade = hillshade(near, size, 16, terrain["sun"])
    steep = 1 - share(slope(near, size), 0.0, terrain["slope"])
    open_ = share(openness(w, halo, size, 16), *terrain["open"])
    sky = share(sky_view(w, halo, size, 16), *terrain["sky"])
    out = 0.5 * shade + 0.5 * steep * shade
    out = 0.5 * out + 0.5 * np.where(out > 0.5, 1 - 2 * (1 - out) * (1 - open_), 2 * out * open_)
    return 0.75 * out + 0.25 * out * sky
