"""Joins with a preference, per-group picks, and decoding of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geomill.functions import geo


def by_stem(stems: DataFrame, known: DataFrame) -> DataFrame:
    """stem with the value of the same name, else of the name without _detections, else the least of names that begin it.

    The prefix step explodes the beginnings of what is still open and joins them by equality, so no inequality join is planned.
    """
    exact = known.withColumnRenamed("name", "stem").withColumnRenamed("value", "v1")
    bare = known.withColumnRenamed("name", "bare").withColumnRenamed("value", "v2")
    d = stems.join(exact, "stem", "left").withColumn("bare", F.regexp_replace("stem", "_detections$", "")).join(bare, "bare", "left")
    open_ = d.where("v1 is null and v2 is null").select("stem", F.explode(F.sequence(F.lit(1), F.length("stem"))).alias("n"))
    open_ = open_.select("stem", F.col("stem").substr(F.lit(1), F.col("n")).alias("name"))
    begun = open_.join(known, "name").groupBy("stem").agg(F.min("value").alias("v3"))
    return d.join(begun, "stem", "left").select("stem", F.coalesce("v1", "v2", "v3").alias("value"))


def first_by(rows: DataFrame, by: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each group in an order, as an aggregation."""
    best = F.min_by(F.struct(*columns), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))))
    return rows.groupBy(*by).agg(best.alias("t")).select(*by, "t.*")


def ordered_distinct(rows: DataFrame, value: str, order: str) -> DataFrame:
    return rows.groupBy(F.col(value).alias("value")).agg(F.min(order).alias("first_at"))


def layer_classes(layers: DataFrame, classes: DataFrame) -> DataFrame:
    """layer with the class of its name, else the first class (cls, o) whose name is part of it, letter case aside.

    Parts of a layer's name are exploded and met by equality, so the size of either side is free.
    """
    low = F.lower(F.col("layer"))
    at = layers.select("layer", F.explode(F.sequence(F.lit(1), F.length("layer"))).alias("i"))
    at = at.select("layer", "i", F.explode(F.sequence(F.lit(1), F.length("layer") - F.col("i") + 1)).alias("n"))
    part = at.select("layer", low.substr(F.col("i"), F.col("n")).alias("name")).distinct()
    found = part.join(classes.select(F.lower("cls").alias("name"), "cls", "o"), "name")
    best = first_by(found, ["layer"], [(F.col("layer") != F.col("cls")).cast("int"), F.col("o")], ["cls"])
    return layers.join(best, "layer", "left")


def grown_extent(rows: DataFrame, by: list[str], share: float) -> DataFrame:
    e = rows.groupBy(*by).agg(F.min("minx").alias("x0"), F.min("miny").alias("y0"), F.max("maxx").alias("x1"), F.max("maxy").alias("y1"))
    dx, dy = share * (F.col("x1") - F.col("x0")), share * (F.col("y1") - F.col("y0"))
    return e.select(*by, (F.col("x0") - dx).alias("minx"), (F.col("y0") - dy).alias("miny"), (F.col("x1") + dx).alias("maxx"), (F.col("y1") + dy).alias("maxy"))


def decode_rows(rows: DataFrame, side: float, threshold: float) -> DataFrame:
    """Rows of a one-stage detector (cx, cy, w, h, logits) as clipped boxes with their best class."""
    conf = F.array_max("logits")
    return rows.withColumns({
        "class_id": geo.argmax(F.col("logits")), "conf": conf,
        "x1": F.greatest(F.lit(0.0), F.col("cx") - F.col("w") / 2), "y1": F.greatest(F.lit(0.0), F.col("cy") - F.col("h") / 2),
        "x2": F.least(F.lit(side), F.col("cx") + F.col("w") / 2), "y2": F.least(F.lit(side), F.col("cy") + F.col("h") / 2),
    }).where((F.col("conf") >= threshold) & (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")))


def decode_queries(rows: DataFrame, min_side: float, class_offset: int) -> DataFrame:
    """Rows of a query detector: sigmoid confidence, small boxes and background gone."""
    rows = rows.withColumn("class_id", geo.argmax(F.col("logits")) - class_offset).withColumn("conf", geo.sigmoid(F.array_max("logits")))
    return rows.where((F.col("w") >= min_side) & (F.col("h") >= min_side) & (F.col("class_id") >= 0))


def _in_image(rows: DataFrame, model_width: float, model_height: float, unit_x: Column, unit_y: Column) -> DataFrame:
    """x1, y1, x2, y2 in pixels of the image (width, height), within it."""
    out = {}
    for a, at, size, side, model, unit in (("x", "cx", "w", "width", model_width, unit_x), ("y", "cy", "h", "height", model_height, unit_y)):
        for i, sign in ((1, -0.5), (2, 0.5)):
            out[f"{a}{i}"] = F.greatest(F.lit(0.0), F.least(F.col(side), (F.col(at) + sign * F.col(size)) * unit * (F.col(side) / model)))
    return rows.withColumns(out)


def rows_in_image(rows: DataFrame, model_width: float, model_height: float, threshold: float) -> DataFrame:
    """Rows of a one-stage detector with their best class and their box in the image (width, height)."""
    d = rows.withColumns({"class_id": geo.argmax(F.col("logits")), "conf": F.array_max("logits")}).where(F.col("conf") >= threshold)
    return _in_image(d, model_width, model_height, F.lit(1.0), F.lit(1.0))


def queries_in_image(rows: DataFrame, model_width: float, model_height: float, threshold: float, class_offset: int, min_side: float = 10.0) -> DataFrame:
    """Rows of a query detector with their best class and their box in the image; small boxes and background go.

    Boxes of an image are shares of the model's input if none of their numbers is above 1.
    """
    shares = rows.groupBy("image").agg((F.max(F.greatest("cx", "cy", "w", "h")) <= 1.0).alias("shares"))
    d = rows.join(shares, "image").withColumns({"class_id": geo.argmax(F.col("logits")) - class_offset, "conf": geo.sigmoid(F.array_max("logits"))})
    d = d.where((F.col("conf") >= threshold) & (F.col("class_id") >= 0))
    unit = [F.when(F.col("shares"), m).otherwise(1.0) for m in (model_width, model_height)]
    d = _in_image(d, model_width, model_height, *unit).drop("shares")
    return d.where((F.col("x2") - F.col("x1") >= min_side) & (F.col("y2") - F.col("y1") >= min_side))


#: Fixed value: an output of so many rows has a row for each detection, however few these are.
LEAST_ROWS = 10


def oriented(cells: DataFrame) -> DataFrame:
    """Raw output cells(image, r, c, x) as a row for each detection: image, row, v. With fewer rows than columns, and fewer than LEAST_ROWS, it is turned."""
    r, n = F.count_distinct("r"), F.count_distinct("c")
    dims = cells.groupBy("image").agg(((r < n) & (r < LEAST_ROWS)).alias("turned"))
    d = cells.join(dims, "image").select("image", F.when(F.col("turned"), F.col("c")).otherwise(F.col("r")).alias("row"), F.when(F.col("turned"), F.col("r")).otherwise(F.col("c")).alias("k"), "x")
    d = d.groupBy("image", "row").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v"))
    return d.select("image", "row", F.transform("v", lambda e: e["x"]).alias("v"))


def class_probabilities(rows: DataFrame, bias: float) -> DataFrame:
    """Softmax with the background lowered by a bias and clipped to 0..1."""
    p = geo.softmax(F.col("logits"))
    lowered = F.transform(p, lambda x, i: F.when(i == 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x - bias))).otherwise(x))
    return rows.withColumn("p", lowered)


def vote(long: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """Mean probability and best class of each pixel over all slices that saw it; sums are in whole units, ties go to the first class."""
    m = long.groupBy("pixel", "cls").agg(F.sum(F.rint(F.col("p") * scale).cast("long")).alias("s"), F.count("*").alias("n"))
    best = F.max_by(F.struct("cls", "n", "s"), F.struct("s", -F.col("cls")))
    return m.groupBy("pixel").agg(best.alias("b")).select("pixel", "b.cls", "b.n", F.round(F.col("b.s") / F.col("b.n") / float(scale) + 1e-9, 6).alias("p"))


def compared(rows: DataFrame, atol: float = 1e-4, rtol: float = 1e-3) -> DataFrame:
    diff = F.abs(F.col("a") - F.col("b"))
    return rows.agg(F.max(diff).alias("max_diff"), F.round(F.avg(diff), 9).alias("mean_diff"), F.bool_and(diff <= atol + rtol * F.abs("b")).alias("close"))


def by_rank(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """Rows of two lists (k, value, tie t) with the same rank within k, the `most` best of each."""

    def ranked(d: DataFrame, value: str) -> DataFrame:
        w = W.partitionBy("k").orderBy(F.col(value).desc(), "t")
        return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("t")

    return ranked(a, "a").join(ranked(b, "b"), ["k", "rank"])
