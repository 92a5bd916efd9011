"""File sources, sinks, modes and the file stream on files made here."""

import json
import struct

import pytest
from geomill.plans import modes
from geomill.sources import clouds, files, sinks
from geomill.streaming.increments import follow, not_done
from pyspark.sql import functions as F


def test_text_sources(spark, tmp_path):
    (tmp_path / "links.txt").write_text("a.laz,http://h/a.laz\n\nhttp://h/d/b.laz\nftp://h/c.laz\n,http://h/\n")
    assert {tuple(r) for r in files.link_list(spark, str(tmp_path / "links.txt")).collect()} == {("a.laz", "http://h/a.laz"), ("b.laz", "http://h/d/b.laz")}
    (tmp_path / "t.jgw").write_text("0.5\n0.0\n0.0\n-0.5\n100000.0\n6500000.0\n")
    assert tuple(files.world_files(spark, str(tmp_path / "t.jgw")).first()) == ("t", 0.5, -0.5, 100000.0, 6500000.0)
    assert files.world_files(spark, str(tmp_path / "t.jgw"), centre=True).first().x0 == 99999.75
    (tmp_path / "i.txt").write_text("0 0.5 0.5 0.1 0.2\n\n1 0.5 0.5 0.1 0.2 0.9\nbad\n2 0 0 1 0 1 1\n1 2 3\n")
    got = {r.line: r for r in files.label_files(spark, str(tmp_path / "i.txt")).collect()}
    assert set(got) == {0, 2, 4} and got[2].confidence == 0.9 and len(got[4].coords) == 6 and got[0].confidence is None
    (tmp_path / "i.json").write_text(json.dumps({"image_path": "i.jpg", "detections": [{"class_id": 1, "confidence": 0.5}, {"class_id": 2}]}))
    assert [(r.line, r.class_id, r.confidence) for r in files.detection_files(spark, str(tmp_path / "i.json")).orderBy("line").collect()] == [(0, 1, 0.5), (1, 2, None)]


def test_point_cloud(spark, tmp_path):
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes((1, 2))
    struct.pack_into("<I", head, 96, 227)
    head[104] = 0
    struct.pack_into("<HI", head, 105, 20, 3)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 1000.0, 2000.0, 0.0)
    body = b"".join(struct.pack("<iiiHBBbBH", i * 100, i * 200, i * 50, 0, 0, c, 0, 0, 0) for i, c in enumerate((2, 6, 1)))
    (tmp_path / "a.las").write_bytes(bytes(head) + body)
    (tmp_path / "b.las").write_bytes(b"nothing")
    got = clouds.points(spark, str(tmp_path)).collect()
    assert sorted((r.x, r.y, r.z, r.classification) for r in got if not r.error) == [(1000.0, 2000.0, 0.0, 2), (1001.0, 2002.0, 0.5, 6), (1002.0, 2004.0, 1.0, 1)]
    assert [r.file for r in got if r.error] == ["b.las"]


def test_sinks(spark, tmp_path):
    text = spark.range(1).select(sinks.world_text(F.lit(0.5), F.lit(-0.5), F.lit(1.0), F.lit(2.0)).alias("v")).first().v
    assert text.split("\n")[0] == "0.5000000000" and len(text.split("\n")) == 6
    rows = spark.createDataFrame([("i", 1, 2, [0.5, 0.25], 0.9), ("i", 0, 1, [0.1, 0.2], 0.8)], "image string, line int, class_id int, coords array<double>, confidence double")
    assert sinks.label_text(rows).first().value == "1 0.100000 0.200000 0.800000\n2 0.500000 0.250000 0.900000"
    images = spark.createDataFrame([("i", 10, 20), ("j", 10, 20)], "image string, width int, height int")
    got = {r.image: json.loads(r.value) for r in sinks.detection_json(images, rows).collect()}
    assert len(got["i"]["detections"]) == 2 and got["j"]["detections"] == []
    sinks.by_class(spark.createDataFrame([("a", None, None, 1)], "class_name string, note string, confidence double, __x int"), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).first().asDict() == {"class_name": "a", "note": "", "confidence": -1.0}


def test_follow_takes_each_file_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / k) for k in ("src", "out", "mark"))
    for n in (3, 5):
        spark.range(n).write.mode("append").parquet(src)
        follow(spark, src, "id long", lambda d: d.withColumn("twice", F.col("id") * 2), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 8
    assert not_done(spark.range(10), spark.range(4), "id").count() == 6


def test_modes(spark):
    s = modes.settings({"processing": {"mnt_resolution": 10.0, "products": {"SLO": True}}, "x": 1})
    assert s["processing"]["tile_overlap"] == 20 and s["processing"]["products"]["MNT"] and modes.settings(None) == modes.DEFAULTS
    for bad in ("", None, "IGN_LAZ", "unknown"):
        with pytest.raises(ValueError):
            modes.runner(bad)
    points = spark.range(400).select((F.col("id") % 20 * 5).cast("double").alias("x"), (F.floor(F.col("id") / 20) * 5).cast("double").alias("y"), F.col("id").cast("double").alias("z"), F.lit(2).alias("classification"))
    got = modes.runner("local_laz", 0.0, 100.0, s).run(points)
    assert set(got) == {"MNT", "SLO"} and got["SLO"].count() == got["MNT"].count() == 110
    assert modes.path_check("a", "").ok is False and modes.path_check("a", "/tmp").ok
    assert not modes.may_start([modes.Check("a", True), modes.Check("b", False)]) and modes.may_start([modes.Check("b", False, critical=False)])


def test_existing_rasters(spark):
    s = modes.settings({"computer_vision": {"selected_model": " m ", "target_rvt": "SVF"}})
    assert s["computer_vision"]["runs"] == [{"model": "m", "target_rvt": "SVF"}]
    files = spark.createDataFrame([("/a/LHD_FXX_0840_6520_x.tif",), ("/a/scan.tif",)], "path string")
    got = modes.runner(" existing_rvt ", s).run(files)
    assert {r.path: r.name for r in got["SVF"].collect()} == {"/a/LHD_FXX_0840_6520_x.tif": "LHD_FXX_0840_6520_SVF_A_LAMB93.tif", "/a/scan.tif": "scan.tif"}
    runs = modes.settings({"computer_vision": {"runs": [{"model": "a", "target_rvt": "LD"}, {"model": "b", "target_rvt": "LD"}, {"model": "c"}]}})
    assert modes.runner("existing_rvt", runs).products() == ["LD"]
