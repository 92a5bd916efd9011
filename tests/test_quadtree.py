"""Joins over cells that split: the same pairs as over equal cells, and no crowded key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomill.operators import graph, quadtree

BOX = "minx double, miny double, maxx double, maxy double"


def crowded_boxes(rng, n):
    """A third in one square of 2, one box a hundred times over, some of no width, the rest spread out; on cell borders too."""
    at = rng.integers(0, 400, (n, 2)) / 2.0
    size = rng.integers(0, 12, (n, 2)) / 2.0
    at[: n // 3] = 64 + rng.integers(0, 64, (n // 3, 2)) / 32.0
    size[: n // 3] = rng.integers(0, 8, (n // 3, 2)) / 32.0
    at[-100:], size[-100:] = (64.5, 64.5), (0.25, 0.25)
    return [(i, "ab"[i % 2], *map(float, p), *map(float, p + s)) for i, (p, s) in enumerate(zip(at, size, strict=True))]


@pytest.mark.parametrize(("most", "depth"), [(40, 8), (40, 1), (25, 0), (10_000, 5)])
def test_same_pairs(spark, most, depth):
    rows = crowded_boxes(np.random.default_rng(1), 600)
    df = spark.createDataFrame(rows, f"id int, k string, {BOX}").repartition(3)
    want = graph.box_pairs(df, df, 16.0, ["k"]).select("id_a", "id_b", "k").collect()
    got = quadtree.box_pairs(df, df, 16.0, ["k"], most, depth).select("id_a", "id_b", "k").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 5_000


def test_two_sides_and_negative_places(spark):
    rng = np.random.default_rng(2)
    a = [(i, *map(float, p - 20), *map(float, p - 18)) for i, p in enumerate(rng.random((200, 2)) * 40)]
    b = [(i, *map(float, p - 20), *map(float, p - 17)) for i, p in enumerate(rng.random((150, 2)) * 5)]
    one, two = spark.createDataFrame(a, f"id int, {BOX}"), spark.createDataFrame(b, f"id int, {BOX}")
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    got = quadtree.box_pairs(one, two, 8.0, most=30).select("id_a", "id_b").collect()
    assert sorted(map(tuple, got)) == want and want
    assert quadtree.box_pairs(one.limit(0), two, 8.0).count() == 0


def test_no_crowded_key(spark):
    """With a third of the rows in one place and copies besides, no key holds more than a few times the others' rows."""
    rng = np.random.default_rng(3)
    rows = [(i, *p, *(p + 0.01)) for i, p in enumerate(np.concatenate([rng.random((3000, 2)) * 1000, 500 + rng.random((1500, 2)), np.full((800, 2), 20.0)]))]
    df = spark.createDataFrame([(r[0], *map(float, r[1:])) for r in rows], f"id int, {BOX}")
    tree = quadtree.crowded(df, 64.0, 50, 12)
    deal = quadtree.dealt(df, tree, 64.0, 50, 12, F.col("id"))
    n = [r["count"] for r in deal.groupBy("level", "cell_x", "cell_y", "salt").count().collect()]
    assert max(n) <= 3 * 50
    plain = [r["count"] for r in df.groupBy(F.floor(F.col("minx") / 64), F.floor(F.col("miny") / 64)).count().collect()]
    assert max(plain) > 10 * max(n)
    one = deal.groupBy("id").count().where("count > 4").count()  # a box touches four cells at most here
    assert one == 0


@pytest.mark.parametrize("most", [30, 100_000])
def test_points(spark, most):
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.integers(0, 80, (150, 2)), 40 + rng.integers(0, 9, (120, 2)) / 4, np.full((30, 2), 7.0)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id int, x double, y double")
    d = ((at[:, None] - at[None]) ** 2).sum(-1)
    got = quadtree.point_pairs(df, 5.0, most).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, np.argwhere(d <= 25.0).tolist()))
