"""Tile records of files, progress of a run, classes by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geomill.functions import geo, names
from geomill.operators.numbering import numbered


def located(files: DataFrame) -> DataFrame:
    """files(name, url, minx, maxy) with x_km, y_km and new_name, in order of tile.

    The corner of the file's own bounds comes first, then the tile of its name; files with neither go. A file whose name
    tells no tile is renamed by its own; of several that would get one name, or where a file has that name already, the
    first by name and url keeps it if it is free and the others get their stem too. Nulls in name or url are empty text.
    """
    told = names.tile_xy(F.col("name"))
    d = files.withColumns({"name": F.coalesce("name", F.lit("")), "url": F.coalesce("url", F.lit(""))})
    corner = F.col("minx").isNotNull() & F.col("maxy").isNotNull()
    for axis, bound in (("x_km", "minx"), ("y_km", "maxy")):
        d = d.withColumn(axis, F.when(corner, geo.km_index(F.col(bound))).otherwise(told[axis]))
    d = d.withColumn("told", told.isNotNull()).where("x_km is not null and y_km is not null")
    d = d.withColumn("plain", F.when(F.col("told"), F.col("name")).otherwise(names.external_cloud(F.col("name"), F.col("x_km"), F.col("y_km"), F.lit(False))))
    w = W.partitionBy("plain")  # files of one tile
    taken = (F.row_number().over(w.orderBy(~F.col("told"), "name", "url")) > 1) & ~F.col("told")
    new = F.when(taken, names.external_cloud(F.col("name"), F.col("x_km"), F.col("y_km"), F.lit(True))).otherwise(F.col("plain"))
    return d.withColumn("new_name", new).drop("told", "plain").orderBy("x_km", "y_km", "name", "url")


def terrain_names(files: DataFrame) -> DataFrame:
    """files(name, x_km, y_km) with the name under which a given terrain raster is taken in."""
    return files.withColumn("new_name", F.concat(F.lit("MNT_EXT_"), names.tile_key(F.col("x_km"), F.col("y_km")), F.lower(names.suffix_of(F.col("name")))))


def progress(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """done, total and percent of each row of a run; halves go to the even neighbour."""
    d = numbered(rows, by, [order]).withColumn("done", F.col("number") + 1).drop("number")
    return d.withColumn("percent", F.rint(100.0 * F.col("done") / F.col("total")).cast("int"))


def with_classes(classes: DataFrame, own: DataFrame) -> DataFrame:
    """Features of classes(class_name, ...) with those of `own`, which replaces classes of the same name; columns may differ."""
    return classes.join(own.select("class_name").distinct(), "class_name", "left_anti").unionByName(own, allowMissingColumns=True)


def by_class_name(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ids that share a class name as one group: n, mean confidence, whole area, ids in order."""
    return rows.groupBy(*by, "class_name").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.sum("area").alias("area"), F.sort_array(F.collect_set("class_id")).alias("class_ids")
    )


def tile_extents(images: DataFrame) -> DataFrame:
    """images(image, width, height, pw, ph, x0, y0) as boxes, whatever the sign of the pixel sides; those with a null go."""
    ends = {"x": (F.col("x0"), F.col("x0") + F.col("pw") * F.col("width")), "y": (F.col("y0"), F.col("y0") + F.col("ph") * F.col("height"))}
    box = [f(*ends[a]).alias(f"{n}{a}") for a in "xy" for n, f in (("min", F.least), ("max", F.greatest))]
    whole = F.lit(True)
    for k in ("width", "height", "pw", "ph", "x0", "y0"):
        whole = whole & F.col(k).isNotNull()
    return images.where(whole).select("image", *box)


def finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose numbers are all there and finite."""
    ok = F.lit(True)
    for k in columns:
        ok = ok & F.col(k).isNotNull() & ~F.isnan(k) & (F.abs(k) < F.lit(float("inf")))
    return rows.where(ok)


def wants_merging(task: Column) -> Column:
    """Whether features of a model's task are merged over tiles: those of segmentation, and of a task that is not known."""
    known = F.coalesce(task, F.lit(""))
    return known.isin("", "instance_segmentation", "semantic_segmentation", "segment")
