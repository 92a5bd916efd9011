"""Triangulation by its defining property, and terrain by blocks against one triangulation of everything."""

import random

import numpy as np
import pytest

from geomill.kernels import hulls, tin
from geomill.operators import raster


def checked(points):
    """The triangles of a mesh as sets of corners, after all neighbours and all circles have been looked at."""
    mesh = tin.Triangulation(points)
    n = len(mesh.corners) // 3
    for t in range(n):
        own = mesh.corners[3 * t : 3 * t + 3]
        for j in range(3):
            other = mesh.beside[3 * t + j]
            u, v = own[(j + 1) % 3], own[(j + 2) % 3]
            assert any(mesh.beside[3 * other + k] == t and mesh.corners[3 * other + (k + 1) % 3] == v and mesh.corners[3 * other + (k + 2) % 3] == u for k in range(3))
        if tin.FAR in own:
            continue
        a, b, c = (points[i] for i in own)
        x, y, r = tin.circle(a, b, c)
        assert (b[0] - a[0]) * (c[1] - a[1]) > (b[1] - a[1]) * (c[0] - a[0])
        assert all(np.hypot(q[0] - x, q[1] - y) >= r * (1 - 1e-9) - 1e-9 for q in points)
    return {tuple(sorted(points[i] for i in t)) for t in mesh.triangles().tolist()}


def test_circles_are_empty_and_order_is_nothing():
    rng = random.Random(1)
    for _ in range(150):
        n, size = rng.randint(1, 40), rng.choice([3, 6, 20, 1000])  # small sizes: many points on one circle or line
        points = list({(rng.randint(0, size), rng.randint(0, size)) for _ in range(n)})
        want = checked(points)
        area = sum(abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) for a, b, c in want) / 2
        ring = hulls.convex(np.array(points, float))
        assert area == pytest.approx(hulls.area(ring) if len(ring) > 2 else 0)
        rng.shuffle(points)
        assert checked(points) == want


def test_local_ties_are_those_of_the_whole():
    """On a full grid every square is a tie; a part of the grid cuts its squares as the whole does."""
    grid = [(i, j) for i in range(9) for j in range(9)]
    whole = checked(grid)
    part = checked([q for q in grid if 2 <= q[0] <= 7 and 1 <= q[1] <= 6])
    assert part == {t for t in whole if all(2 <= x <= 7 and 1 <= y <= 6 for x, y in t)}


def gappy(seed, ties):
    """Two dense places, a line of points, a few far ones; nothing in between."""
    rng = np.random.default_rng(seed)
    dense = [rng.random((250, 2)) * 60, rng.random((200, 2)) * [30, 50] + [260, 190], np.c_[np.linspace(60, 260, 12), np.full(12, 30.0)], rng.random((6, 2)) * [300, 250]]
    xy = np.concatenate(dense)
    xy = np.rint(xy / 5) * 5 if ties else np.rint(xy * 8) / 8
    return xy, np.rint(xy[:, 0] * 3 + (xy[:, 1] - 40) ** 2 / 7)


@pytest.mark.parametrize("ties", [False, True])
def test_blocks_change_no_height(spark, ties):
    x0, y1, size = 1000.0, 5000.0, 4.0
    xy, z = gappy(4, ties)
    df = spark.createDataFrame([(float(x) + x0, float(y) + y1 - 300.0, float(h)) for (x, y), h in zip(xy, z, strict=True)] + [(None, 1.0, 2.0), (1.0, 2.0, None)], "x double, y double, z double")
    places = {}
    for (x, y), h in zip(xy, z, strict=True):
        places.setdefault((x, y - 300.0), []).append(h)
    points, height = np.array(list(places)), np.array([np.mean(h) for h in places.values()])
    c, r = np.meshgrid(np.arange(0, 80), np.arange(0, 80))
    at = np.c_[(c.ravel() + 0.5) * size, -(r.ravel() + 0.5) * size]
    found = tin.interpolate(points, height, at)
    want = {(int(i), int(j)): h for i, j, h in zip(c.ravel(), r.ravel(), found, strict=True) if not np.isnan(h)}
    assert len(want) > 2000
    for block, reach in ((16, 2), (7, 1), (64, 8)):
        got = {(q.col, q.row): q.z for q in raster.terrain(df, x0, y1, size, block, reach).collect()}
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_few_points(spark):
    line = spark.createDataFrame([(0.0, 0.0, 1.0), (10.0, 10.0, 2.0), (20.0, 20.0, 3.0)], "x double, y double, z double")
    assert raster.terrain(line, 0.0, 30.0, 1.0).count() == 0
    assert raster.terrain(line.limit(0), 0.0, 30.0, 1.0).count() == 0
    three = spark.createDataFrame([(0.0, 0.0, 0.0), (10.0, 0.0, 10.0), (0.0, 10.0, 0.0)], "x double, y double, z double")
    got = {(r.col, r.row): r.z for r in raster.terrain(three, 0.0, 10.0, 1.0, 4, 1).collect()}
    assert got and all(h == pytest.approx(c + 0.5) for (c, _), h in got.items()) and (0, 9) in got and (9, 0) not in got


def test_stretch_rounds_near_halves_like_its_sql(spark):
    """11.49998 is 11.5 to four places and so 12, as 12.50002 is 12.5 and so 12; noise of a sum does not decide."""
    values = [11.49998, 12.50002, 11.4999, 12.5001, 11.5 - 1e-12, 12.5 + 1e-12, -3.0, 300.0]
    rows = spark.createDataFrame([(i, v / 255.0) for i, v in enumerate(values)], "col int, value double")
    got = {r.col: r.value for r in raster.stretched(rows, 0.0, 1.0).collect()}
    assert [got[i] for i in range(len(values))] == [12, 12, 11, 13, 12, 12, 0, 255]
