"""Class masks as regions and polygons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geomill.functions import geo
from geomill.kernels import outlines
from geomill.operators.graph import box_pairs, components
from geomill.operators.stages import written


def _runs(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells side by side in a row of one mask as runs: id, row, c0, c1. An id sorts by row, then column."""
    w = W.partitionBy(*by, "row").orderBy("col")  # one row of one image
    d = cells.select(*by, "row", "col").distinct().withColumn("gap", F.col("col") - F.row_number().over(w))
    d = d.groupBy(*by, "row", "gap").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("gap")
    return d.withColumn("id", F.concat_ws("|", *by, F.format_string("%09d", "row"), F.format_string("%09d", "c0")))


def regions(cells: DataFrame, by: list[str], min_area: int = 25, min_compactness: float = 0.0, size: float = 64.0) -> tuple[DataFrame, DataFrame]:
    """Regions of cells(row, col, and the columns of `by`, which tell masks apart), and their runs (region, row, c0, c1).

    Cells that share a side or a corner are one region, named by its first run. Rows: by, region, area in cells, perimeter
    in cell sides (holes too), n_holes, and its box of rows and columns. Regions of less than min_area cells or less
    than min_compactness go. A hole is a cycle of runs that touch, so counts of runs and of touching pairs tell
    their number. Rows and columns are from 0.
    """
    runs = written(_runs(cells, by), "runs")
    edge = {"minx": F.col("c0") - 0.5, "maxx": F.col("c1") + 0.5, "miny": F.col("row") - 0.5, "maxy": F.col("row") + 0.5}
    b = runs.select("id", *by, "row", "c0", "c1", *(e.alias(k) for k, e in edge.items()))
    pairs = written(box_pairs(b, b, size, by).where("row_b = row_a + 1").select("id_a", "id_b", F.greatest(F.lit(0), F.least("c1_a", "c1_b") - F.greatest("c0_a", "c0_b") + 1).alias("shared")), "pairs")
    found = components(runs, pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).withColumnRenamed("component", "region")
    below = pairs.groupBy(F.col("id_a").alias("id")).agg(F.count("*").alias("met"), F.sum("shared").alias("shared"))
    named = written(runs.join(found, "id").join(below, "id", "left"), "named")
    g = named.groupBy(*by, "region").agg(
        F.sum(F.col("c1") - F.col("c0") + 1).alias("area"), F.count("*").alias("n"), F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.coalesce(F.sum("shared"), F.lit(0)).alias("shared"),
        F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("c0").alias("col0"), F.max("c1").alias("col1"),
    )
    g = g.withColumn("perimeter", 2 * F.col("n") + 2 * F.col("area") - 2 * F.col("shared")).withColumn("n_holes", F.col("met") - F.col("n") + 1)
    g = g.where((F.col("area") >= min_area) & (geo.compactness(F.col("area"), F.col("perimeter")) >= min_compactness))
    return g.select(*by, "region", "area", "perimeter", "n_holes", "row0", "row1", "col0", "col1"), named.select("region", "row", "c0", "c1")


def polygons(found: DataFrame, runs: DataFrame) -> DataFrame:
    """The regions with outer, the corners of their outline in cells, and holes, those of their holes.

    A task holds the runs of one region, which lies within one image.
    """

    def traced(pdf: pd.DataFrame) -> pd.DataFrame:
        all_ = outlines.rings(pdf["row"].to_numpy(), pdf["c0"].to_numpy(), pdf["c1"].to_numpy())
        dicts = [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in all_]
        outer = [d for d, ring in zip(dicts, all_, strict=True) if outlines.signed_area(ring) > 0]
        holes = [d for d, ring in zip(dicts, all_, strict=True) if outlines.signed_area(ring) < 0]
        return pd.DataFrame([{"region": pdf["region"].iloc[0], "outer": outer[0], "holes": holes}])

    ring = "array<struct<x:double,y:double>>"
    shapes = runs.join(found.select("region"), "region", "left_semi").groupBy("region").applyInPandas(traced, f"region string, outer {ring}, holes array<{ring}>")
    return found.join(shapes, "region")


def ring_area(ring: Column) -> Column:
    """Area of a ring of corners, whichever way it runs."""
    n = F.size(ring)
    turn = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(turn, F.lit(0.0), lambda a, t: a + t)) / 2.0
