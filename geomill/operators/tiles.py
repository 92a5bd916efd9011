"""Tiles and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.functions import geo, names
from geomill.operators.stages import written


def neighbours(tiles: DataFrame) -> DataFrame:
    """Each tile with those of its eight neighbours that exist: place 1 to 8, dx, dy, neighbour, nx, ny.

    Offsets are exploded and the join is by equal coordinates; of several files of one place the last name counts.
    """
    # written before anything is asked of them: each distinct name is parsed once, for both sides of the join
    t = tiles.select("filename").distinct().select("filename", names.tile_xy(F.col("filename")).alias("xy"))
    t = written(t, "tile-names").where("xy is not null")
    t = t.select("filename", F.col("xy.x_km").alias("x"), F.col("xy.y_km").alias("y"))
    eight = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    offsets = F.array(*(F.struct(F.lit(i + 1).alias("place"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(eight)))
    wanted = t.withColumn("o", F.explode(offsets)).select("filename", "o.*", (F.col("x") + F.col("o.dx")).alias("nx"), (F.col("y") + F.col("o.dy")).alias("ny"))
    index = t.groupBy(F.col("x").alias("nx"), F.col("y").alias("ny")).agg(F.max("filename").alias("neighbour"))
    return wanted.join(index, ["nx", "ny"])


def slices(images: DataFrame, width: str, height: str, size: int, ratio: float) -> DataFrame:
    """A row for each slice of each image with its origin x0, y0; edge slices may repeat."""
    d = images.withColumn("y0", F.explode(geo.slice_starts(F.col(height), size, ratio)))
    return d.withColumn("x0", F.explode(geo.slice_starts(F.col(width), size, ratio)))


def worth_slicing(width: Column, height: Column, side: int) -> Column:
    return F.greatest(width, height) > 1.5 * side


def shifted_clipped(rows: DataFrame, box: dict[str, Column], x0: Column, y0: Column, side: float) -> DataFrame:
    """Boxes of a slice in image pixels, clipped; those with nothing inside go."""
    b = {k: F.greatest(F.lit(0), F.least(F.lit(side), e + (x0 if k[0] == "x" else y0))) for k, e in box.items()}
    return rows.withColumns(b).where("x1 < x2 and y1 < y2")


def with_strips(points: DataFrame, margin: Column) -> DataFrame:
    """Points of each tile with the strips of its neighbours: rows x_km, y_km (the tile they serve), place (0 its own), and the point.

    A point goes to its own tile and to those neighbours within whose margin it lies, edges included. Tiles are those that
    have points of their own; a neighbour without points adds nothing.
    """
    own = points.withColumn("x_km", F.floor(F.col("x") / geo.KM).cast("int")).withColumn("y_km", (F.floor(F.col("y") / geo.KM) + 1).cast("int"))
    eight = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    offsets = F.array(*(F.struct(F.lit(i + 1).alias("place"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(eight)))
    strips = own.withColumn("o", F.explode(offsets))
    b = geo.neighbour_bounds(F.col("o.dx"), F.col("o.dy"), F.col("x_km"), F.col("y_km"), margin)
    strips = strips.where(F.col("x").between(b["xmin"], b["xmax"]) & F.col("y").between(b["ymin"], b["ymax"]))
    served = own.select("x_km", "y_km").distinct()
    strips = strips.withColumns({"x_km": F.col("x_km") - F.col("o.dx"), "y_km": F.col("y_km") - F.col("o.dy"), "place": F.col("o.place")}).drop("o")
    strips = strips.join(served, ["x_km", "y_km"], "left_semi")
    return own.withColumn("place", F.lit(0)).unionByName(strips)
