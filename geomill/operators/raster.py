"""Rasters as cell rows: gridding, overviews, crops, and kernels that see a halo around each block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.kernels import hulls, relief, tin
from geomill.operators.stages import discard, written

BLOCK = 64


def on_grid(points: DataFrame, x0: float, y1: float, size: float) -> DataFrame:
    """points with the col and row of their cell; rows run down from y1."""
    return points.withColumn("col", F.floor((F.col("x") - x0) / size).cast("int")).withColumn("row", F.floor((y1 - F.col("y")) / size).cast("int"))


def density(points: DataFrame, x0: float, y1: float, size: float) -> DataFrame:
    return on_grid(points, x0, y1, size).groupBy("col", "row").agg(F.count("*").alias("n"))


def mean_height(points: DataFrame, x0: float, y1: float, size: float, scale: int = 100) -> DataFrame:
    """Mean z of each cell, summed in whole units of 1/scale so that it does not depend on the order of rows."""
    z = F.sum(F.rint(F.col("z") * scale).cast("long"))
    return on_grid(points, x0, y1, size).groupBy("col", "row").agg((z / F.count("*") / scale).alias("z"))


def overview(cells: DataFrame, level: int) -> DataFrame:
    """Mean of level x level cells."""
    c, r = F.floor(F.col("col") / level).cast("int"), F.floor(F.col("row") / level).cast("int")
    return cells.groupBy(c.alias("col"), r.alias("row")).agg(F.avg("z").alias("z"), F.count("*").alias("n"))


def crop(cells: DataFrame, c0: int, r0: int, c1: int, r1: int) -> DataFrame:
    return cells.where(F.col("col").between(c0, c1 - 1) & F.col("row").between(r0, r1 - 1))


def with_halo(cells: DataFrame, halo: int, kernel, block: int = BLOCK) -> DataFrame:
    """kernel(window array with NaN outside, halo) -> array of the block, for every block of cells(col, row, z).

    A cell is also sent to each neighbour block whose halo holds it, so blocks are independent and bounded in size,
    whatever the extent of the raster. Rows (col, row, value) of the cells that exist.
    """

    def reach(c: str):
        return F.sequence(F.floor((F.col(c) - halo) / block).cast("int"), F.floor((F.col(c) + halo) / block).cast("int"))

    dealt = cells.select("col", "row", F.col("z").cast("double").alias("z")).withColumn("bx", F.explode(reach("col"))).withColumn("by", F.explode(reach("row")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bx, by = key
        side = block + 2 * halo
        window = np.full((side, side), np.nan)
        window[pdf["row"].to_numpy() - by * block + halo, pdf["col"].to_numpy() - bx * block + halo] = pdf["z"].to_numpy()
        out = kernel(window, halo)
        there = ~np.isnan(window[halo : side - halo, halo : side - halo])
        r, c = np.nonzero(there)
        return pd.DataFrame({"col": (c + bx * block).astype("int32"), "row": (r + by * block).astype("int32"), "value": out[r, c]})

    return dealt.groupBy("bx", "by").applyInPandas(run, "col int, row int, value double")


def raised(cells: DataFrame, ve: float) -> DataFrame:
    """Heights times the vertical exaggeration."""
    return cells if ve == 1 else cells.withColumn("z", F.col("z") * float(ve))


def slope(cells: DataFrame, size: float, percent: bool = False, ve: float = 1.0) -> DataFrame:
    return with_halo(raised(cells, ve), 1, lambda w, h: relief.slope(w, size, percent))


def hillshade(cells: DataFrame, size: float, directions: int = 16, elevation: float = 35.0, ve: float = 1.0) -> DataFrame:
    """Mean over evenly spread directions of light."""
    return with_halo(raised(cells, ve), 1, lambda w, h: relief.hillshade(w, size, directions, elevation))


#: Share of the radius in which the horizon is not sought, by level of noise removal.
NOISE = (0.0, 0.1, 0.2, 0.4)


def sky_view(cells: DataFrame, size: float, radius: int = 10, directions: int = 16, noise: int = 0, ve: float = 1.0) -> DataFrame:
    nearest = max(1, round(NOISE[noise] * radius))
    return with_halo(raised(cells, ve), radius, lambda w, h: relief.sky_view(w, h, size, directions, nearest))


def openness(cells: DataFrame, size: float, radius: int = 10, directions: int = 16, noise: int = 0, ve: float = 1.0) -> DataFrame:
    nearest = max(1, round(NOISE[noise] * radius))
    return with_halo(raised(cells, ve), radius, lambda w, h: relief.openness(w, h, size, directions, nearest))


def local_dominance(cells: DataFrame, size: float, inner: int = 10, outer: int = 20, angle: int = 15, height: float = 1.7, ve: float = 1.0) -> DataFrame:
    return with_halo(raised(cells, ve), outer, lambda w, h: relief.local_dominance(w, h, size, inner, angle, height))


def local_relief(cells: DataFrame, radius: int = 20, ve: float = 1.0) -> DataFrame:
    return with_halo(raised(cells, ve), radius, lambda w, h: relief.local_relief(w, h))


def blended(cells: DataFrame, size: float, radius: int = 10, terrain_type: int = 0) -> DataFrame:
    """Hillshade, slope, openness and sky view blended in one pass over the halo; terrain_type 0 general, 1 flat, 2 steep."""
    return with_halo(cells, radius, lambda w, h: relief.blend(w, h, size, relief.TERRAINS[terrain_type]))


def hull_of(points: DataFrame) -> np.ndarray:
    """Corners of the hull of points(x, y): each task keeps the hull of what it has seen, so few rows come to the driver."""

    def corners(batches):
        ring = np.zeros((0, 2))
        for pdf in batches:
            ring = hulls.convex(np.concatenate([ring, pdf[["x", "y"]].to_numpy()]))
        yield pd.DataFrame({"x": ring[:, 0], "y": ring[:, 1]})

    few = points.select("x", "y").mapInPandas(corners, "x double, y double").repartition(16).mapInPandas(corners, "x double, y double")
    rows = np.array([tuple(r) for r in few.collect()], float).reshape(-1, 2)
    return hulls.convex(rows) if len(rows) else rows


def terrain(points: DataFrame, x0: float, y1: float, size: float, block: int = BLOCK, reach: int = 8, steps: int = 1024) -> DataFrame:
    """Heights at the centres of cells on the Delaunay triangulation of all points(x, y, z): rows (col, row, z).

    Each block of cells fetches the points up to `reach` cells around it. It is done when every triangle over one of its
    cells is certain: its circle holds no place inside the hull of all points where nothing was fetched. Other blocks
    come again, with a reach three times as wide, until all are done, so neither block nor reach changes a height. A block in a
    gap of the points sees what lies about as far off as the gap is wide. Cells outside the hull have no height.

    Places are set on a grid of 1/steps and points of one place are averaged first. Fewer than three points off a line: no rows.
    """
    place = [F.rint((F.col("x") - x0) * steps).cast("long").alias("ix"), F.rint((F.col("y") - y1) * steps).cast("long").alias("iy")]
    p = points.where("x is not null and y is not null and z is not null").groupBy(*place).agg(F.avg("z").alias("z"))
    side = float(block * size)
    p = p.select((F.col("ix") / steps).alias("x"), (F.col("iy") / steps).alias("y"), "z")
    p = written(p.withColumns({"px": F.floor(F.col("x") / side), "py": F.floor(-F.col("y") / side)}), "places")
    hull = hull_of(p)
    spark = points.sparkSession
    out = spark.createDataFrame([], "col int, row int, z double")
    if len(hull) < 3:
        return out
    (u0, v0), (u1, v1) = np.floor(np.c_[hull[:, 0], -hull[:, 1]].min(0) / side).astype(int), np.floor(np.c_[hull[:, 0], -hull[:, 1]].max(0) / side).astype(int)
    wide = int(u1 - u0 + 1)

    def touching(batches):
        for pdf in batches:
            keep = []
            for bx, by in zip(pdf["bx"], pdf["by"], strict=True):
                ring = hull
                for axis, limit, below in ((0, (bx + 1) * side, True), (0, bx * side, False), (1, -by * side, True), (1, -(by + 1) * side, False)):
                    ring = tin.clipped(ring, axis, limit, below)
                keep.append(len(ring) > 0)
            yield pdf[keep]

    every = spark.range(wide * int(v1 - v0 + 1)).select((F.col("id") % wide + int(u0)).alias("bx"), (F.floor(F.col("id") / wide) + int(v0)).alias("by"))
    todo = written(every.mapInPandas(touching, "bx long, by long"), "blocks")

    while not todo.isEmpty():
        far = reach * size
        ring = int(np.ceil(reach / block))
        around = [F.explode(F.sequence(F.col(b) - ring, F.col(b) + ring)).alias(k) for b, k in (("bx", "px"), ("by", "py"))]
        asked = todo.select("bx", "by", around[0]).select("bx", "by", "px", around[1])
        near = asked.join(p, ["px", "py"]).where(
            (F.col("x") >= F.col("bx") * side - far) & (F.col("x") < (F.col("bx") + 1) * side + far) & (F.col("y") <= far - F.col("by") * side) & (F.col("y") > -(F.col("by") + 1) * side - far)
        )

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            bx, by = key
            c, r = np.meshgrid(np.arange(bx * block, (bx + 1) * block), np.arange(by * block, (by + 1) * block))
            at = np.c_[(c.ravel() + 0.5) * size, -(r.ravel() + 0.5) * size]
            limits = ((0, bx * side - far, True), (0, (bx + 1) * side + far, False), (1, -(by + 1) * side - far, True), (1, far - by * side, False))
            beyond = [ring for ring in (tin.clipped(hull, *x) for x in limits) if len(ring)]
            z = tin.heights(pdf[["x", "y"]].to_numpy(), pdf["z"].to_numpy(), at, steps, beyond, hull)
            if z is None:
                return pd.DataFrame({"bx": [], "by": [], "col": [], "row": [], "z": []})
            ok = np.flatnonzero(~np.isnan(z))
            rows = pd.DataFrame({"bx": bx, "by": by, "col": c.ravel()[ok], "row": r.ravel()[ok], "z": z[ok]})
            return pd.concat([rows, pd.DataFrame({"bx": [bx], "by": [by], "col": [None], "row": [None], "z": [None]}, dtype=object)])  # the block is done

        done = written(near.groupBy("bx", "by").applyInPandas(run, "bx long, by long, col int, row int, z double"), "heights")
        out = out.unionByName(done.where("col is not null").select("col", "row", "z"))
        last, todo = todo, written(todo.join(done.where("col is null").select("bx", "by"), ["bx", "by"], "left_anti"), "blocks")
        discard(last)
        reach *= 3
    return out


def stretched(cells: DataFrame, low: float, high: float) -> DataFrame:
    """Values as 0 to 255 by a linear stretch; what lies within 5e-5 of a half counts as a half, which goes to the even number."""
    v = F.round((F.col("value") - low) / (high - low) * 255.0 + 1e-7, 4)
    return cells.withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(v))).cast("int"))
