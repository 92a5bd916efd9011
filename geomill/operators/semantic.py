"""Class maps of whole images from the class scores of their slices: softmax, bilinear resampling, votes, bias, threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.functions import geo

#: Probabilities are summed in whole units of 1/UNITS, so that a mean does not depend on the order of slices.
UNITS = 1_000_000_000


def taps(at: Column, have: Column, want: Column) -> tuple[Column, Column, Column]:
    """First and second source place of a place resampled from `have` to `want` with half-pixel centres, and the second's share.

    Beyond the middle of the first and the last source place the value is theirs.
    """
    x = F.least(F.greatest((at + 0.5) * have / want - 0.5, F.lit(0.0)), have - 1.0)
    first = F.floor(x)
    return first, F.least(first + 1, have.cast("long") - 1), x - first


def _blend(a: Column, b: Column, share: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * (1.0 - share) + y * share)


def resampled(cells: DataFrame, slices: DataFrame) -> DataFrame:
    """Probabilities at the pixels of slices: (image, x, y, p) in the image, a row for each slice that shows the pixel.

    cells: image, slice, r, c and logits, an array of one score a class, for each cell of the model's output. slices: image,
    slice, rows and cols of that output, start_x, start_y, width and height of the slice, and img_width, img_height. Rows
    of cells are stretched as arrays first; then each meets the pixel rows that it is one of the two sources of, so a slice
    is never in one task but row by row. Pixels beyond the image go; a slice with a missing cell has none where it is needed.
    """
    rows = cells.select("image", "slice", "r", F.struct("c", geo.softmax(F.col("logits")).alias("p")).alias("cell"))
    rows = rows.groupBy("image", "slice", "r").agg(F.map_from_entries(F.collect_list("cell")).alias("at"))
    d = rows.join(slices, ["image", "slice"])

    def across(x: Column) -> Column:
        first, second, share = taps(x, F.col("cols"), F.col("width"))
        return _blend(F.col("at")[first.cast("int")], F.col("at")[second.cast("int")], share)

    d = d.withColumn("line", F.transform(F.sequence(F.lit(0), F.col("width") - 1), across)).drop("at")
    # each output row y is made of source rows first and second; a source row knows the y that lie within one row of it
    low, high = (F.floor((F.col("r") + k) * F.col("height") / F.col("rows")) for k in (-0.5, 1.5))
    d = d.withColumn("y", F.explode(F.sequence(F.greatest(low - 1, F.lit(0)), F.least(high + 1, F.col("height") - 1).cast("long"))))
    first, second, share = taps(F.col("y"), F.col("rows"), F.col("height"))
    part = F.when(F.col("r") == first, F.lit(1.0) - share).otherwise(0.0) + F.when(F.col("r") == second, share).otherwise(0.0)
    d = d.withColumns({"share": part, "used": (F.col("r") == first) | (F.col("r") == second)}).where("used")
    # both sources of a pixel row meet by its number; a source that is both has the whole share
    d = d.select(
        "image", "slice", (F.col("start_y") + F.col("y")).alias("y"), "start_x", "img_width", "img_height", "share", "line",
        F.when(first == second, 1).otherwise(2).alias("sources"),
    )
    d = d.where("y < img_height").withColumn("line", F.transform("line", lambda p: F.transform(p, lambda v: v * F.col("share"))))
    lines = d.groupBy("image", "slice", "y", "start_x", "img_width").agg(F.sort_array(F.collect_list(F.struct("share", "line"))).alias("two"), F.max("sources").alias("sources"))
    one, other = F.get("two", F.lit(0))["line"], F.get("two", F.lit(1))["line"]
    both = F.when(F.size("two") > 1, F.zip_with(one, other, lambda a, b: F.zip_with(a, b, lambda v, w: v + w))).otherwise(one)
    lines = lines.where(F.size("two") == F.col("sources")).select("image", "y", "start_x", "img_width", F.posexplode(both).alias("at", "p"))
    return lines.select("image", (F.col("start_x") + F.col("at")).alias("x"), "y", "p", "img_width").where("x < img_width and p is not null").drop("img_width")


def class_map(pixels: DataFrame, classes: int, threshold: float, bias: float = 0.0) -> DataFrame:
    """pixels(image, x, y, p) of slices to (image, x, y, cls, conf, votes): the class of the greatest mean probability.

    The background, class 0, is lowered by `bias` and kept within 0 to 1 when there is a bias; ties go to the first class;
    where no class reaches the threshold the pixel is background and keeps its confidence.
    """
    sums = [F.sum(F.rint(F.get("p", F.lit(k)) * UNITS).cast("long")).alias(f"s{k}") for k in range(classes)]
    d = pixels.groupBy("image", "x", "y").agg(F.count("*").alias("votes"), *sums)
    mean = [F.col(f"s{k}") / F.col("votes") / float(UNITS) for k in range(classes)]
    if bias > 0:
        mean[0] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean[0] - bias))
    d = d.select("image", "x", "y", "votes", F.array(*mean).alias("m")).withColumn("conf", F.array_max("m"))
    best = F.array_position("m", F.col("conf")).cast("int") - 1
    return d.select("image", "x", "y", F.when(F.col("conf") < threshold, 0).otherwise(best).alias("cls"), "conf", "votes")
