"""Point clouds (uncompressed LAS) read by ranges of records and written in files of bounded size."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.sources.ranges import Ranged, put

BOUNDS = ["minx", "miny", "minz", "maxx", "maxy", "maxz"]
_HEADER = pa.schema(
    [("path", pa.string()), ("name", pa.string()), *((k, pa.float64()) for k in BOUNDS), ("points", pa.int64()), ("start", pa.int64()), ("kind", pa.int32()), ("record", pa.int32())]
    + [("scale", pa.list_(pa.float64())), ("taken", pa.int64()), ("error", pa.string())]
)
_HEADER_SQL = f"path string, name string, {', '.join(f'{k} double' for k in BOUNDS)}, points long, start long, kind int, record int, scale array<double>, taken long, error string"
_POINT = pa.schema([("file", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("classification", pa.int32()), ("error", pa.string())])
#: Fixed values of the public format description: least record of kinds 0 to 10, header of version 1.4, offset of the class before and from kind 6 on.
_RECORDS = (20, 28, 26, 34, 57, 63, 30, 36, 38, 59, 67)
_HEAD, _OLD_CLASS, _CLASS = 375, 15, 16


def _header(f: Ranged) -> dict:
    if f.read(0, 4) != b"LASF":
        raise ValueError("not a point cloud")
    maxx, minx, maxy, miny, maxz, minz = f.unpack("<6d", 179)
    out = dict(zip(BOUNDS, (minx, miny, minz, maxx, maxy, maxz), strict=True))
    (start,), (kind, record, points) = f.unpack("<I", 96), f.unpack("<BHI", 104)
    if f.unpack("<B", 25)[0] >= 4 and not points:
        (points,) = f.unpack("<Q", 247)
    return out | {"points": points, "start": start, "kind": kind, "record": record, "scale": list(f.unpack("<6d", 131))}


def whole(f: Ranged) -> None:
    """ValueError unless the cloud's records, or the chunk table of a packed one, lie within the file. Header and at most one offset are read."""
    try:
        h = _header(f)
    except struct.error:
        raise ValueError("cut short") from None
    if h["kind"] < 128:
        end = h["start"] + h["points"] * h["record"]
    else:
        end = f.unpack("<q", h["start"])[0] + 8 if h["points"] and f.size >= h["start"] + 8 else h["start"] + 8 * (h["points"] > 0)
    if f.size < end:
        raise ValueError("cut short")


def headers(spark: SparkSession, folder: str, pattern: str = "*.la[sz]") -> DataFrame:
    """path, name, bounds, points, start, kind (with the bit of packed clouds), record, scale, taken (bytes read) and error, a row a file.

    Two or three blocks of 256 bytes of a file are read. Files without a byte are not listed by Spark and have no row.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                row = {"path": path, "name": path.rsplit("/", 1)[-1]}
                try:
                    with Ranged(path) as f:
                        row |= _header(f) | {"taken": f.taken}
                except (ValueError, struct.error) as e:
                    row["error"] = str(e)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_HEADER)

    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")  # contents are not read
    return d.mapInArrow(read, _HEADER_SQL)


def points(spark: SparkSession, folder: str, pattern: str = "*.las", window: tuple[float, float, float, float] | None = None, records: int = 2_000_000) -> DataFrame:
    """file, x, y, z, classification, error of LAS files; a file that cannot be read, or is cut short, is one row with its error.

    A file becomes rows of `records` point records each, which are dealt over tasks, so a large file is read by many. With a
    window (minx, miny, maxx, maxy), files whose header bounds lie outside are not opened again, and only points inside it
    or on its border are given. A task holds 100,000 records at a time.
    """
    d = headers(spark, folder, pattern)
    spare = F.lit(list(_RECORDS))
    need = F.get(spare, F.col("kind"))
    error = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("kind") >= 128, "packed").when(need.isNull() | (F.col("record") < need), "unknown records")
    )
    d = d.withColumn("error", error)
    if window is not None:
        x0, y0, x1, y1 = map(float, window)
        d = d.where((F.col("maxx") >= x0) & (F.col("minx") <= x1) & (F.col("maxy") >= y0) & (F.col("miny") <= y1) | F.col("error").isNotNull())
    starts = F.when(F.col("error").isNull() & (F.col("points") > 0), F.sequence(F.lit(0).cast("long"), F.col("points") - 1, F.lit(records).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    d = d.where("points > 0 or error is not null").select("path", "name", "points", "start", "kind", "record", "scale", "error", F.explode(starts).alias("first"))
    # a row here is some 50 MB of a file: they are dealt one by one, as a hash of so few would be uneven
    d = d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["error"] is None:
                    yield from _range(r, records, window)
                else:
                    yield pa.RecordBatch.from_pylist([{"file": r["name"], "error": r["error"]}], schema=_POINT)

    return d.mapInArrow(read, "file string, x double, y double, z double, classification int, error string")


def _range(r: dict, records: int, window: tuple | None) -> Iterator[pa.RecordBatch]:
    new = r["kind"] >= 6
    one = np.dtype({"names": ["x", "y", "z", "c"], "formats": ["<i4", "<i4", "<i4", "u1"], "offsets": [0, 4, 8, _CLASS if new else _OLD_CLASS], "itemsize": r["record"]})
    with Ranged(r["path"]) as f:
        if f.size < r["start"] + r["points"] * r["record"]:
            if r["first"] == 0:
                yield pa.RecordBatch.from_pylist([{"file": r["name"], "error": "cut short"}], schema=_POINT)
            return
        last = min(r["first"] + records, r["points"])
        for at in range(r["first"], last, 100_000):
            n = min(100_000, last - at)
            p = np.frombuffer(f.file.read_at(n * r["record"], r["start"] + at * r["record"]), one)
            x, y, z = (p[k] * r["scale"][i] + r["scale"][3 + i] for i, k in enumerate("xyz"))
            c = (p["c"] if new else p["c"] & 0x1F).astype(np.int32)
            if window is not None:
                on = (x >= window[0]) & (x <= window[2]) & (y >= window[1]) & (y <= window[3])
                x, y, z, c = x[on], y[on], z[on], c[on]
            yield pa.RecordBatch.from_arrays([pa.array([r["name"]] * len(x), pa.string()), *map(pa.array, (x, y, z, c)), pa.nulls(len(x), pa.string())], schema=_POINT)


def write(cloud: DataFrame, folder: str, scale: tuple[float, float, float], offset: tuple[float, float, float], cell: float = 1000.0, most: int = 1_000_000) -> DataFrame:
    """Write cloud(x, y, z, classification) as LAS 1.4 files of records of kind 6; file and n of those written (an action writes them).

    Points are ordered by cell of the map, so that a file's bounds are narrow; a file has at most `most` points (30 bytes each), so a
    crowded cell becomes several files. Points without x, y or z are left out, a missing class is 0, and a place beyond what the
    scale can hold is an error. A name is set by the task's number and the file's, so a repeated task writes the same files.
    """
    d = cloud.select(*(F.col(k).cast("double").alias(k) for k in "xyz"), F.coalesce(F.col("classification").cast("int"), F.lit(0)).alias("classification"))
    cells = [F.floor(F.col(k) / cell) for k in "xy"]
    d = d.where("x is not null and y is not null and z is not null").repartitionByRange(*cells, "x", "y", "z").sortWithinPartitions(*cells, "x", "y", "z", "classification")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, n, k = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - n)
                held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
                if n == most:
                    yield _saved(held, f"part-{task:05d}-{k:05d}.las")
                    held, n, k = [], 0, k + 1
        if n:
            yield _saved(held, f"part-{task:05d}-{k:05d}.las")

    def _saved(held: list[pa.RecordBatch], name: str) -> pa.RecordBatch:
        put(folder, name, _las(pa.Table.from_batches(held), scale, offset))
        return pa.RecordBatch.from_pydict({"file": [name], "n": pa.array([sum(b.num_rows for b in held)], pa.int64())})

    return d.mapInArrow(save, "file string, n long")


def _las(t: pa.Table, scale: tuple, offset: tuple) -> list[bytes]:
    one = np.zeros(t.num_rows, np.dtype({"names": ["x", "y", "z", "returns", "c"], "formats": ["<i4", "<i4", "<i4", "u1", "u1"], "offsets": [0, 4, 8, 14, _CLASS], "itemsize": _RECORDS[6]}))
    sides = []
    for i, k in enumerate("xyz"):
        steps = np.rint((t[k].to_numpy() - offset[i]) / scale[i])
        if not (np.abs(steps) < 2.0**31).all():
            raise ValueError(f"{k} does not fit the scale")
        one[k] = steps
        sides += [steps.max() * scale[i] + offset[i], steps.min() * scale[i] + offset[i]]
    one["c"], one["returns"] = t["classification"].to_numpy(), 0x11
    head = bytearray(_HEAD)
    head[:4] = b"LASF"
    struct.pack_into("<BB", head, 24, 1, 4)
    struct.pack_into("<HIIBHI", head, 94, _HEAD, _HEAD, 0, 6, _RECORDS[6], 0)
    struct.pack_into("<12d", head, 131, *scale, *offset, *sides)
    struct.pack_into("<QQ", head, 247, len(one), len(one))
    return [bytes(head), one.tobytes()]
