"""Headers of files, settings beside weights, and small record operators, on files made here."""

import json
import struct

import numpy as np
import pytest
from geomill.kernels import outlines
from geomill.operators import records
from geomill.plans import modes
from geomill.sources import files, headers, settings, sinks
from pyspark.sql import functions as F


def tiff(order: str, place: bool) -> bytes:
    tags = [(256, 3, 1, struct.pack(order + "HH", 40, 0)), (257, 4, 1, struct.pack(order + "I", 30))]
    if place:
        at = 8 + 2 + 4 * 12 + 4
        tags += [(33550, 12, 3, struct.pack(order + "I", at)), (33922, 12, 6, struct.pack(order + "I", at + 24))]
    body = struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "HHI", t, k, n) + v for t, k, n, v in tags) + bytes(4)
    data = struct.pack(order + "3d", 0.5, 0.5, 0.0) + struct.pack(order + "6d", 0, 0, 0, 840000.0, 6520000.0, 0) if place else b""
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + body + data


def test_places(spark, tmp_path):
    for name, order, place in (("a.tif", "<", True), ("b.tif", ">", True), ("c.tif", "<", False)):
        (tmp_path / name).write_bytes(tiff(order, place))
    (tmp_path / "d.asc").write_text("ncols 4\nnrows 3\nxllcorner 100\nyllcorner 200\ncellsize 2\nNODATA_value -9999\n1 2 3 4\n")
    (tmp_path / "e.tif").write_bytes(b"no raster")
    got = {r.name: tuple(r)[1:] for r in headers.raster_places(spark, str(tmp_path)).collect()}
    assert got["a.tif"] == got["b.tif"] == (40.0, 30.0, 0.5, -0.5, 840000.0, 6520000.0, None)
    assert got["c.tif"][2:6] == (1.0, 1.0, 0.0, 0.0) and got["d.asc"][:6] == (4.0, 3.0, 2.0, -2.0, 100.0, 206.0) and got["e.tif"][6]
    head = bytearray(227)
    head[:4] = b"LASF"
    struct.pack_into("<6d", head, 179, 840999.0, 840000.0, 6520001.0, 6519000.0, 9.0, 1.0)
    (tmp_path / "f.laz").write_bytes(bytes(head))
    (tmp_path / "g.las").write_bytes(b"short")
    got = {r.name: r for r in headers.cloud_bounds(spark, str(tmp_path)).collect()}
    assert (got["f.laz"].minx, got["f.laz"].maxy, got["f.laz"].maxz) == (840000.0, 6520001.0, 9.0) and got["g.las"].error
    (tmp_path / "h.jgw").write_text("0.5\n0\n0\n-0.5\n100.25\n199.75\n")
    (tmp_path / "h.jpg").write_bytes(b"x")
    at = {r.name: (r.minx, r.maxy) for r in headers.corners(spark, str(tmp_path)).collect()}
    assert at == {"a.tif": (840000.0, 6520000.0), "b.tif": (840000.0, 6520000.0), "d.asc": (100.0, 206.0), "f.laz": (840000.0, 6520001.0), "h.jpg": (100.0, 200.0)}
    d = spark.createDataFrame([(k, x, y, "") for k, (x, y) in at.items()], "name string, minx double, maxy double, url string")
    assert {r.name: r.new_name for r in records.located(d).collect()}["f.laz"] == "IGN_EXT_0840_6520.laz"
    assert [r.name for r in files.usable(files.listing(spark, str(tmp_path), "*.tif")).collect()] == ["a.tif", "b.tif", "c.tif", "e.tif"]


def test_metadata_corner(spark):
    rows = [(json.dumps({"a": [{"minx": 1, "maxy": 2}, {"b": {"minx": 3, "maxy": 4}}], "minx": 9}),), ("{}",), ("no",), (None,)]
    got = [r.c for r in spark.createDataFrame(rows, "t string").coalesce(1).select(headers.metadata_corner(F.col("t")).alias("c")).collect()]
    assert tuple(got[0]) == (3.0, 4.0) and got[1:] == [None, None, None]


def test_settings_beside_weights(spark, tmp_path):
    pytest.importorskip("yaml")
    assert settings.class_names(spark, str(tmp_path)) is None and settings.arguments(spark, str(tmp_path)) == {}
    (tmp_path / "classes.json").write_text('{"0": "a", "2": " c "}')
    assert settings.class_names(spark, str(tmp_path)) == ["a", "classe_1", "c"]
    (tmp_path / "class_names.txt").write_bytes(b"\xef\xbb\xbfx\n\n y \n")
    assert settings.class_names(spark, str(tmp_path)) == ["x", "y"]
    (tmp_path / "args.yaml").write_text("class_colors: [1, 13, bad]\nsahi: {slice_width: '320'}\nclustering:\n  target_class: pit\n  eps_m: 5\n")
    args = settings.arguments(spark, str(tmp_path))
    assert settings.class_colours(args) == [1, 1, 0] and settings.class_colours({}) is None
    assert settings.slicing(args) == {"slice_height": 640, "slice_width": 320, "overlap_ratio": 0.2} and settings.slicing({"sahi": {"slice_width": "x"}}) == settings.SLICING
    (one,) = settings.clustering(args)
    assert one["target_classes"] == ["pit"] and one["eps_m"] == 5.0 and one["output_class_name"] == "cluster_pit" and settings.clustering({"clustering": [{}]}) is None
    (tmp_path / "model_metadata.json").write_text('{"task": "segment"}')
    assert settings.metadata(spark, str(tmp_path)) == {"task": "segment"}


def test_colour_map():
    assert settings.colour_map([(["a", "b", "c"], [1, 1]), (["c", "d"], [0, 5])]) == {"a": 1, "c": 0, "d": 5, "b": 2}
    many = settings.colour_map([([f"c{i}" for i in range(14)], None)])
    assert [many[f"c{i}"] for i in range(14)] == [*range(12), 0, 1]


def test_odd_records(spark):
    d = spark.createDataFrame([("s.laz", None, 1000.0, 2000.0), ("s.laz", "u", 1000.0, 2000.0), (None, None, None, None), ("LHD_FXX_0001_0002_x.laz", "v", None, None)], "name string, url string, minx double, maxy double")
    assert [(r.x_km, r.y_km, r.new_name) for r in records.located(d).collect()] == [(1, 2, "LHD_FXX_0001_0002_x.laz"), (1, 2, "IGN_EXT_0001_0002.laz"), (1, 2, "IGN_EXT_0001_0002_s.laz")]
    t = spark.createDataFrame([("segment",), (None,), ("object_detection",)], "t string").select(records.wants_merging(F.col("t")).alias("w"))
    assert [r.w for r in t.collect()] == [True, True, False]
    v = spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0), (1.0, float("inf")), (None, 1.0)], "a double, b double")
    assert records.finite(v, ["a", "b"]).count() == 1
    r = spark.createDataFrame([("LHD.TIF", 3, 4)], "name string, x_km int, y_km int")
    assert records.terrain_names(r).first().new_name == "MNT_EXT_0003_0004.tif"


def test_list_sinks(spark, tmp_path):
    d = spark.createDataFrame([("b", "u", 2, 1), ("a", "v", 1, 9)], "name string, url string, x_km int, y_km int")
    sinks.sorted_list(d, str(tmp_path / "l"))
    assert [r.value for p in sorted((tmp_path / "l").glob("*.txt")) for r in spark.read.text(str(p)).collect()] == ["a,v", "b,u"]
    for names_ in (["x", "y"], ["z"]):
        sinks.class_list(spark.createDataFrame(list(enumerate(names_)), "place int, name string"), str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["x", "y"]
    f = spark.createDataFrame([("a", 5.0), ("b", 50.0)], "class_name string, area double")
    sinks.split_small(f, str(tmp_path / "s"), 10.0)
    assert spark.read.parquet(str(tmp_path / "s" / "detections")).first().class_name == "b"
    assert spark.read.parquet(str(tmp_path / "s" / "detections_filtered_too_small")).first().class_name == "a"


def test_product_settings(spark):
    s = modes.settings({"processing": {"mnt_resolution": 1.0, "products": {k: True for k in modes.PRODUCTS}}, "rvt_params": {"slope": {"save_as_8bit": False, "ve_factor": 2}}})
    cells = spark.range(100).select((F.col("id") % 10).cast("int").alias("col"), F.floor(F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("double").alias("z"))
    got = modes.runner("existing_mnt", s).run(cells)
    assert set(got) == set(modes.PRODUCTS) and got["SLO"].where("col = 5 and row = 5").first().value == pytest.approx(np.degrees(np.arctan(2.0)))
    assert got["SVF"].agg(F.min("value"), F.max("value")).first()[0] >= 0 and dict(got["M_HS"].dtypes)["value"] == "int"


def test_outlines_of_random_masks():
    """Signed areas of all rings add up to the cells, and there is one outer ring."""
    rng = np.random.default_rng(0)
    for _ in range(50):
        mask = np.ones((6, 6), bool)
        mask[1:5, 1:5] = rng.random((4, 4)) < 0.5
        runs = [(r, c, c) for r, c in np.argwhere(mask)]
        areas = [outlines.signed_area(x) for x in outlines.rings(*np.array(runs).T)]
        assert areas[0] > 0 and max(areas) == 36
