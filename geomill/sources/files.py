"""File sources as DataFrames: link lists, labels, detection JSON, world files, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.functions import names

DETECTIONS = (
    "image_path string, image_dimensions struct<width:int,height:int>, task string, model_type string, "
    "detections array<struct<class_id:int,confidence:double,polygon:array<double>,polygon_holes:array<array<double>>,"
    "bbox_absolute:struct<minx:double,miny:double,maxx:double,maxy:double>>>"
)


def link_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines `name,url` or `url` as (name, url); blank lines, other schemes and empty names are left out."""
    line = F.trim("value")
    two = F.split(line, ",", 2)
    url = names.unwrapped(F.trim(F.when(F.size(two) == 2, F.get(two, F.lit(1))).otherwise(line)))
    name = F.when(F.size(two) == 2, F.trim(F.get(two, F.lit(0)))).otherwise(names.url_file(url))
    return spark.read.text(path).select(name.alias("name"), url.alias("url")).where("url rlike '^(https?|file)://' and name <> ''")


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name and length of files below a folder, in order of path, each once, contents not read."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return d.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length").distinct().orderBy("path")


def usable(files: DataFrame) -> DataFrame:
    """Files of a listing that hold anything."""
    return files.where("length > 0")


def world_files(spark: SparkSession, path: str, centre: bool = False) -> DataFrame:
    """stem, pw, ph, x0, y0 of six-line world files. The origin is a corner, or with `centre` the middle of the first pixel.

    Files with fewer lines or other text give nulls.
    """
    d = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.split(F.trim("value"), r"\s+").alias("v"))
    n = lambda i: F.get("v", F.lit(i)).try_cast("double")
    shift = 0.5 if centre else 0.0
    return d.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"), n(0).alias("pw"), n(3).alias("ph"), (n(4) - shift * n(0)).alias("x0"), (n(5) - shift * n(3)).alias("y0"))


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """stem, line (from 0, blank and bad lines counted), class_id, coords, confidence.

    Five fields are a box, six a box with confidence, seven or more of odd number a polygon; other lines are left out.
    """
    d = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    f = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    d = d.select(F.regexp_replace("file", r"\.txt$", "").alias("stem"), "line", F.transform(f, lambda x: x.try_cast("double")).alias("v"))
    n = F.size("v")
    d = d.where((n.isin(5, 6) | ((n >= 7) & (n % 2 == 1))) & ~F.exists("v", lambda x: x.isNull()))
    return d.select("stem", "line", F.get("v", F.lit(0)).cast("int").alias("class_id"), F.slice("v", 2, F.when(n.isin(5, 6), 4).otherwise(n - 1)).alias("coords"), F.when(n == 6, F.get("v", F.lit(5))).alias("confidence"))


def detection_files(spark: SparkSession, path: str) -> DataFrame:
    """stem, line and the fields of each detection of JSON files."""
    d = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.from_json("value", DETECTIONS).alias("j"))
    d = d.select(F.regexp_replace("file", r"\.json$", "").alias("stem"), "j.task", F.posexplode_outer("j.detections").alias("line", "d"))
    return d.where("d is not null").select("stem", "task", "line", "d.*")
