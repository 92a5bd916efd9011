"""Point clouds written and read by ranges, against the points themselves."""

import random
import struct

from geomill.sources import clouds
from geomill.sources.ranges import Ranged


def cloud(spark, n):
    r = random.Random(n)
    rows = [(r.randrange(300000) / 100, r.randrange(200000) / 100, r.randrange(9999) / 100, r.randrange(256)) for _ in range(n)] + [(1.0, 2.0, 3.0, 4)] * 5
    return rows, spark.createDataFrame(rows, "x double, y double, z double, classification int").repartition(3)


def told(rows):
    return sorted((round(x, 2), round(y, 2), round(z, 2), c) for x, y, z, c in rows)


def test_round_trip(spark, tmp_path):
    rows, d = cloud(spark, 3000)
    d = d.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1), (9.0, 9.0, 9.0, None)], d.schema))
    folder = str(tmp_path / "c")
    for _ in range(2):  # a repeated run replaces its files
        files = clouds.write(d, folder, (0.01, 0.01, 0.01), (0.0, 0.0, 0.0), most=400).collect()
    assert sum(f.n for f in files) == len(rows) + 1 and max(f.n for f in files) == 400
    assert sorted(p.name for p in (tmp_path / "c").iterdir() if p.suffix == ".las") == sorted(f.file for f in files)
    for records in (7, 400, 100_000):
        got = clouds.points(spark, folder, records=records).drop("file", "error").collect()
        assert told(got) == told([*rows, (9.0, 9.0, 9.0, 0)])
    w = (500.0, 300.0, 900.0, 1200.0)
    got = clouds.points(spark, folder, window=w, records=50)
    assert told(got.drop("file", "error").collect()) == told(r for r in rows if w[0] <= r[0] <= w[2] and w[1] <= r[1] <= w[3])
    assert got.select("file").distinct().count() < len(files)
    assert clouds.write(d.limit(0), str(tmp_path / "e"), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)).count() == 0


def test_headers_read_little(spark, tmp_path):
    _, d = cloud(spark, 2000)
    clouds.write(d, str(tmp_path), (0.01, 0.01, 0.01), (0.0, 0.0, 0.0)).collect()
    h = clouds.headers(spark, str(tmp_path)).collect()
    assert h and all(r.taken <= 512 and r.error is None for r in h) and sum(r.points for r in h) == 2005
    one = max(tmp_path.glob("*.las"), key=lambda p: p.stat().st_size)
    with Ranged(str(one)) as f:
        assert f.read(1000, 30) == one.read_bytes()[1000:1030] and f.taken <= 512 and f.read(f.size - 3, 9) == one.read_bytes()[-3:] and f.read(f.size + 900, 5) == b""


def test_bad_files(spark, tmp_path):
    _, d = cloud(spark, 50)
    clouds.write(d.coalesce(1), str(tmp_path), (0.01, 0.01, 0.01), (0.0, 0.0, 0.0)).collect()
    raw = max(tmp_path.glob("*.las"), key=lambda p: p.stat().st_size).read_bytes()
    for p in tmp_path.glob("*.las"):
        p.unlink()
    packed, unknown = bytearray(raw), bytearray(raw)
    packed[104] |= 0x80
    struct.pack_into("<H", unknown, 105, 4)
    for name, body in (("cut", raw[:-1]), ("packed", packed), ("unknown", unknown), ("text", b"LASF"), ("none", b""), ("good", raw)):
        (tmp_path / f"{name}.las").write_bytes(bytes(body))
    got = clouds.points(spark, str(tmp_path), records=3).collect()
    bad = {r.file: r.error for r in got if r.error}
    assert set(bad) == {"cut.las", "packed.las", "unknown.las", "text.las"} and bad["cut.las"] == "cut short" and sum(r.error is not None for r in got) == 4
    assert {r.file for r in got if not r.error} == {"good.las"}
