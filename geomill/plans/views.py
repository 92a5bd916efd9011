"""Views of the business tables as tiles, labels, boxes, points and scores; each in DataFrame form and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.functions import geo


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label row for each line item: tile, class, confidence and a relative box."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_quantity").cast("int")).alias("id"),
        (800 + c("l_suppkey") % 10).cast("int").alias("x_km"), (6500 + c("l_partkey") % 10).cast("int").alias("y_km"),
        ((c("l_linenumber") - 1) % 4).cast("int").alias("class_id"), (c("l_quantity") / 50.0).alias("confidence"),
        ((c("l_orderkey") % 1000).cast("double") / 1000.0).alias("cx"),
        (((c("l_partkey") * 7 + c("l_suppkey") * 13) % 1000).cast("double") / 1000.0).alias("cy"),
        ((c("l_quantity") + 4.0) / 2000.0).alias("w"), ((4.0 + c("l_linenumber").cast("double") * 6.0) / 2000.0).alias("h"),
    )


LABELS = """labels AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(trunc(l_quantity) AS INT)) AS id,
    CAST(800 + l_suppkey % 10 AS INT) AS x_km, CAST(6500 + l_partkey % 10 AS INT) AS y_km, CAST((l_linenumber - 1) % 4 AS INT) AS class_id,
    l_quantity / 50.0E0 AS confidence, CAST(l_orderkey % 1000 AS DOUBLE) / 1000.0E0 AS cx,
    CAST((l_partkey * 7 + l_suppkey * 13) % 1000 AS DOUBLE) / 1000.0E0 AS cy,
    (l_quantity + 4.0E0) / 2000.0E0 AS w, (4.0E0 + CAST(l_linenumber AS DOUBLE) * 6.0E0) / 2000.0E0 AS h FROM lineitem)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels in map units: images of 2000 pixels of 0.5 m from the tile's corner."""
    d = labels(spark, sf_dir)
    image = {"width": F.lit(2000.0), "height": F.lit(2000.0), "pw": F.lit(0.5), "ph": F.lit(-0.5), "x0": F.col("x_km") * 1000.0, "y0": F.col("y_km") * 1000.0}
    b = geo.box_to_map(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), image)
    d = d.select("id", "x_km", "y_km", "class_id", "confidence", *(v.alias(k) for k, v in b.items()))
    return d.withColumn("area", geo.area(geo.box()))


BOXES = (
    LABELS
    + """, boxes0 AS (
  SELECT id, x_km, y_km, class_id, confidence, x_km * 1000.0E0 + cx * 2000.0E0 * 0.5E0 AS xc, y_km * 1000.0E0 + cy * 2000.0E0 * -0.5E0 AS yc,
    w * 2000.0E0 * 0.5E0 / 2.0E0 AS hw, h * 2000.0E0 * 0.5E0 / 2.0E0 AS hh FROM labels),
boxes1 AS (SELECT id, x_km, y_km, class_id, confidence, xc - hw AS minx, yc - hh AS miny, xc + hw AS maxx, yc + hh AS maxy FROM boxes0),
boxes AS (SELECT *, (maxx - minx) * (maxy - miny) AS area FROM boxes1)"""
)


def unique_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each id."""
    d = boxes(spark, sf_dir)
    rest = [c for c in d.columns if c != "id"]
    return d.groupBy("id").agg(F.max(F.struct(*rest)).alias("r")).select("id", "r.*")


UNIQUE = """ub AS (SELECT id, r.* FROM (SELECT id, max(struct_pack(x_km := x_km, y_km := y_km, class_id := class_id, confidence := confidence,
    minx := minx, miny := miny, maxx := maxx, maxy := maxy, area := area)) AS r FROM boxes GROUP BY id))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classified point for each line item."""
    c = F.col
    kinds = F.array(*(F.lit(k) for k in (2, 6, 66, 67, 9, 1)))
    return table(spark, sf_dir, "lineitem").select(
        (800000.0 + ((c("l_orderkey") * 31 + c("l_suppkey")) % 2000).cast("double")).alias("x"),
        (6500000.0 + ((c("l_partkey") * 17 + c("l_linenumber")) % 2000).cast("double")).alias("y"),
        (c("l_extendedprice") / 1000.0).alias("z"),
        F.coalesce(F.get(kinds, c("l_linenumber") - 1), F.lit(3)).alias("classification"),
    )


POINTS = """points AS (
  SELECT 800000.0E0 + CAST((l_orderkey * 31 + l_suppkey) % 2000 AS DOUBLE) AS x,
    6500000.0E0 + CAST((l_partkey * 17 + l_linenumber) % 2000 AS DOUBLE) AS y, l_extendedprice / 1000.0E0 AS z,
    CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 3 THEN 66 WHEN 4 THEN 67 WHEN 5 THEN 9 WHEN 6 THEN 1 ELSE 3 END AS classification
  FROM lineitem)"""

#: The default of the point filter, which is SQL.
KEPT = "Classification = 2 OR Classification = 6 OR Classification = 66 OR Classification = 67 OR Classification = 9"


def ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(KEPT)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile for each part and supplier that occur together, with its file name."""
    d = table(spark, sf_dir, "lineitem").select((800 + F.col("l_suppkey") % 100).cast("int").alias("x"), (6500 + F.col("l_partkey") % 100).cast("int").alias("y"))
    d = d.distinct()
    return d.select(F.format_string("LHD_FXX_%04d_%04d_PTS_C_LAMB93.copc.laz", "x", "y").alias("filename"))


TILES = """tiles AS (SELECT DISTINCT 'LHD_FXX_' || lpad(CAST(800 + l_suppkey % 100 AS VARCHAR), 4, '0') || '_' || lpad(CAST(6500 + l_partkey % 100 AS VARCHAR), 4, '0')
    || '_PTS_C_LAMB93.copc.laz' AS filename FROM lineitem)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as raw model output: a box and three logits."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", (320.0 + 640.0 * e(0)).alias("cx"), (320.0 + 640.0 * e(1)).alias("cy"),
        (16.0 + 200.0 * F.abs(e(2))).alias("w"), (16.0 + 200.0 * F.abs(e(3))).alias("h"), F.array(e(4), e(5), e(6)).alias("logits"),
    )


SCORES = """scores AS (SELECT vec_id, label, 320.0E0 + 640.0E0 * CAST(embedding[1] AS DOUBLE) AS cx, 320.0E0 + 640.0E0 * CAST(embedding[2] AS DOUBLE) AS cy,
    16.0E0 + 200.0E0 * abs(CAST(embedding[3] AS DOUBLE)) AS w, 16.0E0 + 200.0E0 * abs(CAST(embedding[4] AS DOUBLE)) AS h,
    CAST(embedding[5] AS DOUBLE) AS s0, CAST(embedding[6] AS DOUBLE) AS s1, CAST(embedding[7] AS DOUBLE) AS s2 FROM embeddings)"""


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page links in four wrappings."""
    u, k = F.col("url"), F.col("page_id")
    escaped = F.replace(F.replace(u, F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(k % 4 == 0, F.concat(F.lit("https://urldefense.com/v3/__"), u, F.lit("/t_"), k.cast("string"), F.lit(".laz__;!!x")))
        .when(k % 4 == 1, F.concat(F.lit("https://eur01.safelinks.protection.outlook.com/?url="), escaped, F.lit("&data=1")))
        .when(k % 4 == 2, F.concat(F.lit("text "), u, F.lit("/LHD_FXX_0840_6520.copc.laz trailing")))
        .otherwise(u).alias("raw"),
    )


URLS = """urls AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'https://urldefense.com/v3/__' || url || '/t_' || CAST(page_id AS VARCHAR) || '.laz__;!!x'
    WHEN 1 THEN 'https://eur01.safelinks.protection.outlook.com/?url=' || replace(replace(url, ':', '%3A'), '/', '%2F') || '&data=1'
    WHEN 2 THEN 'text ' || url || '/LHD_FXX_0840_6520.copc.laz trailing' ELSE url END AS raw FROM pages)"""
