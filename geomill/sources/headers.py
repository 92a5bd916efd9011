"""Where files lie on the map, by their headers: point clouds, TIFF and ASCII rasters, images, metadata documents."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from geomill.sources import clouds
from geomill.sources.files import world_files
from geomill.sources.ranges import Ranged


def _headers(spark: SparkSession, folder: str, pattern: str, parse: Callable[[Ranged], tuple], fields: list[str]) -> DataFrame:
    """name, the doubles that parse(file) gives, and error, a row a file. Only the blocks that parse asks for are read."""
    schema = pa.schema([("name", pa.string()), *((f, pa.float64()) for f in fields), ("error", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                row = {"name": path.rsplit("/", 1)[-1]}
                try:
                    with Ranged(path) as f:
                        row |= dict(zip(fields, parse(f), strict=True))
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    row["error"] = str(e) or type(e).__name__
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")  # contents are not read
    return d.mapInArrow(read, ", ".join(["name string", *(f"{f} double" for f in fields), "error string"]))


def cloud_bounds(spark: SparkSession, folder: str, pattern: str = "*.la[sz]") -> DataFrame:
    """name, minx, miny, minz, maxx, maxy, maxz, error of point clouds, packed or not: packed ones keep the public header."""
    return clouds.headers(spark, folder, pattern).select("name", *clouds.BOUNDS, "error")


#: Tags of the TIFF and GeoTIFF descriptions, and bytes and letters of their number types.
_WIDTH, _HEIGHT, _SCALE, _TIE, _MATRIX = 256, 257, 33550, 33922, 34264
_TYPES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 12: (8, "d"), 16: (8, "Q")}


def tiff_place(f: Ranged) -> tuple:
    """width, height, pw, ph, x0, y0 of a TIFF; without a place on the map that of a pixel grid (1, 1, 0, 0)."""
    order = {b"II": "<", b"MM": ">"}.get(f.read(0, 2))
    kind = f.unpack(order + "H", 2)[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF")
    whole = "Q" if kind == 43 else "I"
    (at,) = f.unpack(order + whole, 8 if kind == 43 else 4)
    (n,), at, step, room = (f.unpack(order + "Q", at), at + 8, 20, 8) if kind == 43 else (f.unpack(order + "H", at), at + 2, 12, 4)
    tags = {}
    for here in range(at, at + n * step, step):
        tag, kind = f.unpack(order + "HH", here)
        (count,) = f.unpack(order + whole, here + 4)
        if tag in (_WIDTH, _HEIGHT, _SCALE, _TIE, _MATRIX) and kind in _TYPES:
            size, letter = _TYPES[kind]
            value = here + step - room if size * count <= room else f.unpack(order + whole, here + step - room)[0]
            tags[tag] = f.unpack(f"{order}{count}{letter}", value)
    side = float(tags[_WIDTH][0]), float(tags[_HEIGHT][0])
    if _SCALE in tags and _TIE in tags:
        (pw, ph), (i, j, _, x, y, _) = tags[_SCALE][:2], tags[_TIE][:6]
        return *side, pw, -ph, x - i * pw, y + j * ph
    if _MATRIX in tags:
        m = tags[_MATRIX]
        return *side, m[0], m[5], m[3], m[7]
    return *side, 1.0, 1.0, 0.0, 0.0


def ascii_place(f: Ranged) -> tuple:
    """width, height, pw, ph, x0, y0 of an ASCII grid, by its first lines."""
    head = {}
    for line in f.read(0, 1000).decode("ascii", "ignore").splitlines()[:6]:
        parts = line.split()
        if len(parts) == 2 and parts[0][:1].isalpha():
            head[parts[0].lower()] = float(parts[1])
    width, height, size = head["ncols"], head["nrows"], head["cellsize"]
    x0 = head["xllcorner"] if "xllcorner" in head else head["xllcenter"] - size / 2
    y0 = head["yllcorner"] if "yllcorner" in head else head["yllcenter"] - size / 2
    return width, height, size, -size, x0, y0 + height * size


def raster_places(spark: SparkSession, folder: str, pattern: str = "*.{tif,tiff,asc}") -> DataFrame:
    """name, width, height, pw, ph, x0, y0, error of rasters; the origin is the upper left corner."""
    place = lambda f: tiff_place(f) if f.read(0, 2) in (b"II", b"MM") else ascii_place(f)
    return _headers(spark, folder, pattern, place, ["width", "height", "pw", "ph", "x0", "y0"])


def bounds(places: DataFrame) -> DataFrame:
    """places with minx, miny, maxx, maxy."""
    x1, y1 = F.col("x0") + F.col("pw") * F.col("width"), F.col("y0") + F.col("ph") * F.col("height")
    return places.withColumns({"minx": F.least("x0", x1), "maxx": F.greatest("x0", x1), "miny": F.least("y0", y1), "maxy": F.greatest("y0", y1)})


def image_sizes(spark: SparkSession, folder: str, pattern: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """image, width and height of images by Spark's image source; files that do not decode go."""
    d = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("image.origin", "/"), -1)
    return d.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("image"), "image.width", "image.height")


def metadata_corner(text: Column) -> Column:
    """struct(minx, maxy) of the last object in a JSON document, at any depth, that has both; null if there is none."""

    def walk(node):
        if isinstance(node, dict):
            if "minx" in node and "maxy" in node:
                yield node
            for child in node.values():
                yield from walk(child)
        elif isinstance(node, list):
            for child in node:
                yield from walk(child)

    def corner(document):
        try:
            last = None
            for last in walk(json.loads(document)):
                pass
            return (None, None) if last is None else (float(last["minx"]), float(last["maxy"]))
        except (TypeError, ValueError, RecursionError):
            return None, None

    @pandas_udf("minx double, maxy double")
    def found(documents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([corner(x) for x in documents], columns=["minx", "maxy"], dtype="float64")

    got = found(text)
    return F.when(got["minx"].isNotNull() & ~F.isnan(got["minx"]), got)


def corners(spark: SparkSession, folder: str) -> DataFrame:
    """name, minx, maxy of all files of a folder whose kind tells: clouds and rasters by header, photographs by their world file."""
    clouds = cloud_bounds(spark, folder).where("error is null").select("name", "minx", "maxy")
    rasters = bounds(raster_places(spark, folder).where("error is null and not (pw = 1 and ph = 1 and x0 = 0 and y0 = 0)")).select("name", "minx", "maxy")
    photos = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg}").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    worlds = world_files(spark, f"{folder.rstrip('/')}/*.jgw", centre=True).where("x0 is not null") if _any(spark, folder, "*.jgw") else None
    if worlds is None:
        return clouds.unionByName(rasters)
    placed = photos.withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", "")).join(worlds, "stem").select("name", F.col("x0").alias("minx"), F.col("y0").alias("maxy"))
    return clouds.unionByName(rasters).unionByName(placed)


def _any(spark: SparkSession, folder: str, pattern: str) -> bool:
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return d.select("path").limit(1).count() > 0
