"""Hand-derived values for the Column functions and kernels."""

import numpy as np
import pytest
from geomill.functions import geo, names
from geomill.kernels import boxes, hulls, relief, tin
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("c", "i", "want"),
    [(0.19, 0, ("[0:0.2[", "color0_low")), (0.2, 3, ("[0.2:0.4[", "color3_medium_low")), (0.8, 1, ("[0.8:1]", "color1_high")),
     (7.0, 2, ("[0.6:0.8[", "color2_medium_high")), (11.0, 2, ("[0.8:1]", "color2_high")), (None, 1, (None, None))],
)
def test_bucket(spark, c, i, want):
    k = F.lit(c).cast("double")
    assert (one(spark, geo.bucket(k)), one(spark, geo.bucket_colour(k, F.lit(i)))) == want


def test_colours(spark):
    def rgb(i, c):
        return tuple(one(spark, geo.shaded(F.lit(i), F.lit(c), k)) for k in range(3))

    assert rgb(0, 0.9) == (178, 41, 41) and rgb(0, 0.5) == (255, 59, 59) and rgb(1, 0.1) == (183, 237, 183) and rgb(13, 0.5) == (50, 205, 50)


def test_numbers(spark):
    assert [one(spark, geo.margin(F.lit(p))) for p in (20, 5, 0, 150, -3)] == [200, 50, 0, 999, 0]
    assert [one(spark, geo.km_index(F.lit(float(v)))) for v in (840003, 839996, 840006, 839990)] == [840, 840, 840, 839]
    for text, want in (("2.5", 2.5), (None, 9.0), ("", 9.0), ("abc", 9.0), ("-3.5", -3.5), ("1d", 9.0), ("1,5", 9.0)):
        assert one(spark, names.safe_float(F.lit(text), 9.0)) == want
    assert one(spark, names.whole(F.lit("1,7"), 0)) == 1 and one(spark, names.whole(F.lit("-1.7"), 0)) == -1


def test_neighbour_bounds(spark):
    def b(dx, dy, x, y):
        return tuple(one(spark, geo.neighbour_bounds(F.lit(dx), F.lit(dy), F.lit(x), F.lit(y), F.lit(200))))

    assert b(-1, -1, 839, 6519) == (839800, 840000, 6518800, 6519000) and b(1, 1, 841, 6521) == (841000, 841200, 6520000, 6520200)


def test_names(spark):
    assert tuple(one(spark, names.tile_xy(F.lit("LHD_FXX_0840_6520_PTS.copc.laz")))) == (840, 6520)
    assert one(spark, names.tile_xy(F.lit("a_b.tif"))) is None
    assert [one(spark, names.duration(F.lit(s))) for s in (5.04, 65.0, 3700.0)] == ["5.0s", "1min 5s", "1h 1min"]
    for url, want in (
        ("https://urldefense.com/v3/__http://h/a.laz__;!!x", "http://h/a.laz"),
        ("https://urldefense.proofpoint.com/v2/url?u=http-3A__h_a.laz&d=", "http://h/a.laz"),
        ("http://x/y", "http://x/y"),
    ):
        assert one(spark, names.unwrapped(F.lit(url))) == want


def test_slices(spark):
    starts = lambda n: one(spark, geo.slice_starts(F.lit(n), 640, 0.2))
    assert starts(2000) == [0, 512, 1024, 1360] and starts(640) == [0, 0]
    with pytest.raises(ValueError):
        geo.slice_starts(F.lit(10), 640, 1.0)


def test_boxes():
    b = np.array([[0, 0, 10, 10], [5, 0, 15, 10], [40, 0, 50, 10.0]])
    assert boxes.greedy(b, 0.5, "IOS").tolist() == [True, False, True]
    assert boxes.greedy(b, 0.5, "IOU").tolist() == [True, True, True]
    split = np.array([[4, -5, 6, 15], [0, 0, 10, 10.0]])  # the second is cut in two


def test_hull_and_triangles():
    rng = np.random.default_rng(1)
    p = rng.random((80, 2))
    ring = hulls.convex(p)
    assert all(((b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) >= -1e-12).all() for a, b in zip(ring, np.roll(ring, -1, 0), strict=True))
    assert hulls.area(np.array([[0, 0], [2, 0], [2, 1], [0, 1]])) == 2
    assert hulls.area(hulls.smallest_rectangle(np.array([[0, 1], [1, 0], [2, 1], [1, 2.0]]))) == pytest.approx(2)
    z = 3 * p[:, 0] - 2 * p[:, 1] + 1  # a plane comes back exactly
    at = p[:40] * 0.5 + p[40:] * 0.5
    assert tin.interpolate(p, z, at) == pytest.approx(3 * at[:, 0] - 2 * at[:, 1] + 1)
    t = tin.triangles(p)
    assert sum(hulls.area(p[i]) for i in t) == pytest.approx(hulls.area(ring), rel=1e-6)


def test_relief():
    y, x = np.mgrid[0:12, 0:12].astype(float)
    assert relief.slope(x, 1.0) [1:-1, 1:-1] == pytest.approx(45.0)
    flat = np.zeros((12, 12))
    assert relief.sky_view(flat, 3, 1.0, 8) == pytest.approx(1.0)
    assert relief.local_relief(flat + 7, 2) == pytest.approx(0.0)
    assert relief.hillshade(flat, 1.0, 8, 35.0) == pytest.approx(np.sin(np.radians(35)))
    assert relief.openness(flat, 3, 1.0, 8) == pytest.approx(90.0)
    assert (relief.local_dominance(flat, 5, 1.0, 2, 15, 1.7) > 0).all()
