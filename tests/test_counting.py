"""Counts of boxes that meet against all pairs."""

import numpy as np
import pytest
from geomill.kernels import counting
from geomill.operators import quadtree


def crowd(n, seed, wide=40):
    r = np.random.default_rng(seed)
    low = r.integers(-wide, wide, (n, 2)) / 4
    return np.c_[low, low + r.integers(0, 14, (n, 2)) / 4]


def by_pairs(a, z):
    return ((a[:, None, :2] <= z[None, :, 2:]) & (z[None, :, :2] <= a[:, None, 2:])).all(-1).sum(1)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 500])
def test_meeting(n):
    a, z = crowd(n, n), crowd(n + 7, n + 1)
    assert (counting.meeting(a, z) == by_pairs(a, z)).all() and (counting.meeting(a, a[:0]) == 0).all()


@pytest.mark.parametrize(("size", "most"), [(16.0, 10_000), (8.0, 60), (4.0, 5)])
def test_met_by_leaves(spark, size, most):
    box = crowd(700, 5, 60)
    rows = spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(box)] + [(900, 500.0, 500.0, 501.0, 501.0)], "id int, minx double, miny double, maxx double, maxy double")
    want = by_pairs(box, box) - 1
    assert {r.id: r.n for r in quadtree.met(rows, size, most, 4).collect()} == {i: n for i, n in enumerate(want.tolist()) if n}


def test_met_in_a_crowd(spark):
    """400,000 boxes over each other: 160 billion pairs are counted, not made."""
    rows = spark.range(400_000).selectExpr("id", "cast(id % 1000 as double) / 1000 AS minx", "cast(id * 7919 % 997 as double) / 1000 AS miny").selectExpr("*", "minx + 3 AS maxx", "miny + 3 AS maxy")
    got = quadtree.met(rows, 64.0, 20_000, 3).groupBy("n").count().collect()
    assert [(r.n, r["count"]) for r in got] == [(399_999, 400_000)]


@pytest.mark.parametrize("n", [30, 1500])
def test_met_here_counts_what_begins_in_the_cell(n):
    box = crowd(n, n, 12)
    both = np.maximum(box[:, None, :2], box[None, :, :2])
    meet = ((box[:, None, :2] <= box[None, :, 2:]) & (box[None, :, :2] <= box[:, None, 2:])).all(-1)
    assert (counting.met_here(box, -1.0, 0.5) == (meet & (both[..., 0] >= -1.0) & (both[..., 1] >= 0.5)).sum(1)).all()
