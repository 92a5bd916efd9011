"""Sinks: world files, label files, detections by class."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.sources.ranges import put


def world_text(pw: Column, ph: Column, x0: Column, y0: Column, rotation: tuple[Column, Column] | None = None) -> Column:
    """The six lines of a world file; rotations below 1e-10 are 0."""
    zero = F.lit(0.0)
    r = [F.when(F.abs(k) < 1e-10, zero).otherwise(k) for k in rotation] if rotation else [zero, zero]
    return F.concat_ws("\n", *(F.format_string("%.10f", k) for k in (pw, r[0], r[1], ph, x0, y0)))


def label_text(rows: DataFrame) -> DataFrame:
    """image with the lines of its label file, in order of `line`; coordinates have six decimals."""
    line = F.concat_ws(" ", F.col("class_id").cast("string"), F.transform("coords", lambda v: F.format_string("%.6f", v)), F.format_string("%.6f", "confidence"))
    d = rows.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("line", line.alias("text")))).alias("r"))
    return d.select("image", F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("value"))


def without_lines(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Label or detection rows without the (image, line) that were removed; lines keep their order."""
    return rows.join(removed.select("image", "line").distinct(), ["image", "line"], "left_anti")


def split_small(features: DataFrame, folder: str, min_area: float) -> None:
    """Features of at least min_area by class, and the others beside them."""
    by_class(features.where(F.col("area") >= min_area), f"{folder}/detections")
    by_class(features.where(F.col("area") < min_area), f"{folder}/detections_filtered_too_small")


def sorted_list(records: DataFrame, folder: str) -> None:
    """name,url lines in order of tile, in ordered part files."""
    d = records.orderBy("x_km", "y_km", "name", "url")
    d.select(F.concat_ws(",", "name", "url").alias("value")).write.mode("overwrite").text(folder)


def class_list(names: DataFrame, folder: str) -> None:
    """names(place, name) as lines, unless there is a list already."""
    names.orderBy("place").coalesce(1).select("name").write.mode("ignore").text(folder)  # a line a class


def detection_json(images: DataFrame, rows: DataFrame) -> DataFrame:
    """image with its detection JSON; images without detections have an empty list."""
    own = rows.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("line", "class_id", "confidence", "coords"))).alias("r"))
    d = images.join(own, "image", "left")
    kept = F.transform(F.coalesce("r", F.array()), lambda x: F.struct(x["class_id"].alias("class_id"), x["confidence"].alias("confidence"), x["coords"].alias("polygon")))
    body = F.struct(F.col("image").alias("image_path"), F.struct("width", "height").alias("image_dimensions"), kept.alias("detections"))
    return d.select("image", F.to_json(body).alias("value")) if "r" in d.columns else d


def by_class(features: DataFrame, folder: str) -> None:
    """Features as Parquet, a folder a class; text fields are filled with "" and a missing confidence is -1."""
    kept = [c for c in features.columns if not c.startswith("__")]
    text = [c for c, t in features.dtypes if t == "string" and c in kept and c != "class_name"]
    d = features.select(*kept).fillna("", text)
    if "confidence" in kept:
        d = d.fillna({"confidence": -1.0})
    d.write.mode("overwrite").partitionBy("class_name").parquet(folder)


def each(rows: DataFrame, folder: str) -> DataFrame:
    """A file for each of rows(name, text); name and bytes of those written (an action writes them). Names are to differ."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [{"name": r["name"], "bytes": put(folder, r["name"], [(r["text"] or "").encode()])} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("name", pa.string()), ("bytes", pa.int64())]))

    return rows.select("name", "text").mapInArrow(save, "name string, bytes long")
