"""Registered queries of whole flows: label files to features, tiles with their strips, sliced detection, clustering, de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from geomill.functions import geo, names
from geomill.operators import detections as det
from geomill.operators import labels, tiles
from geomill.operators.stages import written
from geomill.plans import views as v
from geomill.plans.queries import c, query, settled

# ---- label files to features ---------------------------------------------------------------------------------

_FILES = f"""WITH {v.LABELS}, l AS (SELECT CASE WHEN x_km % 5 = 0 THEN 'SCAN_' || y_km ELSE 'LHD_FXX_' || lpad(CAST(x_km AS VARCHAR), 4, '0') || '_' || lpad(CAST(y_km AS VARCHAR), 4, '0') || '_LD' END
    || CASE WHEN y_km % 2 = 0 THEN '_detections' ELSE '' END AS stem, x_km, y_km, class_id, confidence, cx, cy, w, h FROM labels)"""


def _files(spark, d):
    """Labels with file names: some of tiles, some without a place in the name."""
    own = F.concat(F.lit("LHD_FXX_"), names.tile_key(c("x_km"), c("y_km")), F.lit("_LD"))
    stem = F.when(c("x_km") % 5 == 0, F.concat(F.lit("SCAN_"), c("y_km").cast("string"))).otherwise(own)
    return v.labels(spark, d).withColumn("stem", F.concat(stem, F.when(c("y_km") % 2 == 0, "_detections").otherwise("")))


def _features(spark, d):
    files = _files(spark, d)
    stems = written(files.groupBy("stem").agg(F.max("x_km").alias("x_km"), F.max("y_km").alias("y_km")), "stems")  # a row for each file: all below reads this
    images = stems.select(F.replace("stem", F.lit("_detections"), F.lit("")).alias("image"), "x_km", "y_km").groupBy("image").agg(F.max("x_km").alias("x"), F.max("y_km").alias("y"))
    images = written(images, "images")
    sizes = images.where("y % 3 <> 0").select("image", (1000 + 100 * (c("y") % 7)).alias("width"), (1500 + 100 * (c("x") % 3)).alias("height"))
    worlds = images.where("x % 4 = 1").select("image", F.lit(0.25).alias("pw"), F.lit(-0.25).alias("ph"), (c("x") * 1000.0 + 1).alias("x0"), (c("y") * 1000.0 - 1).alias("y0"))
    transforms = images.where("x % 3 = 0").select(c("image").alias("name"), F.lit(1.0).alias("pw"), F.lit(-1.0).alias("ph"), (c("x") * 1000.0).alias("x0"), (c("y") * 1000.0).alias("y0"))
    places = written(labels.placed(stems, sizes, worlds, transforms), "places")
    return labels.features(files, places, [" mound", "pit", "wall "], {"pit": 7})


@query(_FILES + """, im AS (SELECT replace(stem, '_detections', '') AS image, max(x_km) AS x, max(y_km) AS y FROM l GROUP BY 1),
p AS (SELECT DISTINCT stem, image, x, y FROM (SELECT stem, replace(stem, '_detections', '') AS image FROM l) JOIN im USING (image)),
g AS (SELECT stem, CASE WHEN y % 3 <> 0 THEN 1000 + 100 * (y % 7) ELSE 2000 END AS width, CASE WHEN y % 3 <> 0 THEN 1500 + 100 * (x % 3) ELSE 2000 END AS height,
  CASE WHEN x % 4 = 1 THEN 'world' WHEN x % 3 = 0 THEN 'raster' ELSE 'name' END AS source, x, y, starts_with(stem, 'LHD') AS named FROM p),
q AS (SELECT *, CASE source WHEN 'world' THEN 0.25E0 WHEN 'raster' THEN 1.0E0 ELSE 0.5E0 END AS pw, x * 1000.0E0 + CASE source WHEN 'world' THEN 1 ELSE 0 END AS x0,
  y * 1000.0E0 + CASE source WHEN 'world' THEN -1 WHEN 'raster' THEN 0 ELSE 1000 END AS y0 FROM g WHERE source <> 'name' OR named),
f AS (SELECT l.*, q.*, coalesce(['mound', 'pit', 'wall'][class_id + 1], 'classe_' || (class_id + 1)) AS class_name,
  CASE WHEN named THEN string_split(l.stem, '_')[3] || '_' || string_split(l.stem, '_')[4] ELSE 'global' END AS tile FROM l JOIN q ON q.stem = l.stem),
e AS (SELECT *, x0 + cx * width * pw AS xc, y0 - cy * height * pw AS yc, w * width * pw / 2.0E0 AS hw, h * height * pw / 2.0E0 AS hh FROM f)
SELECT tile, class_name, source, 'color' || CASE class_name WHEN 'pit' THEN 7 ELSE class_id END || '_' || CASE WHEN confidence < 0.2 THEN 'low' WHEN confidence < 0.4 THEN 'medium_low' WHEN confidence < 0.6 THEN 'medium' WHEN confidence < 0.8 THEN 'medium_high' ELSE 'high' END AS conf_color,
  count(*) AS n, count(*) FILTER ((2 * hw) * (2 * hh) < 100) AS too_small, min(xc - hw) AS minx, max(xc + hw) AS maxx, min(yc - hh) AS miny, max(yc + hh) AS maxy
FROM e WHERE confidence >= 0.3 GROUP BY ALL""")
def label_files_to_features(spark, d):
    f = _features(spark, d).where(c("confidence") >= 0.3)
    return f.groupBy("tile", "class_name", "source", "conf_color").agg(
        F.count("*").alias("n"), F.count_if(c("area") < 100).alias("too_small"),
        F.min("minx").alias("minx"), F.max("maxx").alias("maxx"), F.min("miny").alias("miny"), F.max("maxy").alias("maxy"),
    )


# ---- tiles ---------------------------------------------------------------------------------------------------


@query(f"""WITH {v.POINTS}, k AS (SELECT x, y, z, CAST(floor(x / 1000) AS INT) AS vx, CAST(floor(y / 1000) AS INT) + 1 AS vy FROM points WHERE classification IN (2, 6, 66, 67, 9)),
o AS (SELECT dx, dy, CAST(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE row_number() OVER (PARTITION BY dx = 0 AND dy = 0 ORDER BY dx, dy) END AS INT) AS place
  FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
s AS (SELECT vx - dx AS x_km, vy - dy AS y_km, place, z FROM k, o WHERE (dx = 0 OR CASE WHEN dx < 0 THEN x >= 1000 * vx + 800 ELSE x <= 1000 * vx + 200 END)
  AND (dy = 0 OR CASE WHEN dy < 0 THEN y >= 1000 * vy - 200 ELSE y <= 1000 * (vy - 1) + 200 END)),
t AS (SELECT DISTINCT vx, vy FROM k)
SELECT x_km, y_km, place, count(*) AS n, max(z) AS top FROM s JOIN t ON t.vx = x_km AND t.vy = y_km GROUP BY ALL""")
def tile_points(spark, d):
    p = tiles.with_strips(v.ground(spark, d).select("x", "y", "z"), geo.margin(F.lit(20)))
    return p.groupBy("x_km", "y_km", "place").agg(F.count("*").alias("n"), F.max("z").alias("top"))


@query("""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_size AS s, p_retailprice AS r FROM part)
SELECT k, CASE WHEN s % 3 = 0 THEN NULL ELSE (800 + s) * 1000.0E0 END AS x0, CASE WHEN s % 3 = 0 THEN 'r' || k || '.tif' ELSE 'LHD_FXX_0' || (800 + s) || '_6520_SVF_A_LAMB93.tif' END AS raster,
  'IGN_EXT_0' || (800 + s) || '_6520' || CASE WHEN k % 2 = 0 THEN '_c' || k || '.copc' ELSE '' END || '.laz' AS cloud, CAST(s AS INT) AS colour,
  CASE s % 3 WHEN 0 THEN 'SVF' WHEN 1 THEN 'MNT' ELSE 'index' END AS layer, 'cluster_a_b' AS cluster,
  CASE s % 2 WHEN 0 THEN [3, s + 2] ELSE [2, 4, 8, 16, 32, 64] END AS levels, 4.0E0 * 3.14159E0 * s / (r * r) AS compactness,
  CAST(trunc((r * 100 + 500) / 1000) AS INT) AS tile_x, CAST(trunc((r * 200 + 500) / 1000) AS INT) + 1 AS tile_y,
  printf('%d %.6f %.6f %.6f %.6f', s, (2.0E0 * s + 10) / 2 / 631, (4.0E0 * s + 20) / 2 / 479, 10.0E0 / 631, 20.0E0 / 479) AS line FROM p""")
def name_forms(spark, d):
    k, s, r = c("p_partkey").cast("string"), c("p_size"), c("p_retailprice")
    tile = F.concat(F.lit("LHD_FXX_"), names.tile_key(800 + s, F.lit(6520)), F.lit("_MNT.tif"))
    x = F.when(s % 3 != 0, 800 + s)
    path = F.when(s % 3 == 0, "/out/SVF/tif/index.vrt").when(s % 3 == 1, "/out/MNT/tif/index.vrt").otherwise("/out/a/b.vrt")
    side = {"x1": s.cast("double"), "y1": s * 2.0, "x2": s + 10.0, "y2": s * 2.0 + 20.0}
    centre = geo.cloud_tile(r * 100.0, r * 200.0, r * 100.0 + 1000.0, r * 200.0 + 1000.0)
    return v.table(spark, d, "part").select(
        c("p_partkey").cast("long").alias("k"), names.anchor(F.when(s % 3 != 0, tile).otherwise("scan"))["x"].alias("x0"),
        names.normalised_raster(F.concat(F.lit("r"), k, F.lit(".tif")), x, F.lit(6520), F.lit("SVF")).alias("raster"),
        names.external_cloud(F.concat(F.lit("c"), k, F.lit(".copc.laz")), 800 + s, F.lit(6520), c("p_partkey") % 2 == 0).alias("cloud"),
        names.colour_index(F.concat(F.lit("color"), s.cast("string"), F.lit("_high"))).alias("colour"), names.raster_layer(path).alias("layer"),
        names.cluster_name(F.lit(""), F.array(F.lit("a"), F.lit("b"))).alias("cluster"),
        names.pyramid_levels(F.when(s % 2 == 0, F.concat(F.lit("1, 3;x;"), (s + 2).cast("string")))).alias("levels"),
        geo.compactness(s.cast("double"), r).alias("compactness"), centre["x_km"].alias("tile_x"), centre["y_km"].alias("tile_y"),
        geo.label_text(s, side, F.lit(631.0), F.lit(479.0)).alias("line"),
    )


# ---- detections ----------------------------------------------------------------------------------------------


def slices_of_scores(spark, d):
    """Raw model rows as rows of the slices of some images."""
    k = c("vec_id")
    return v.scores(spark, d).select(
        k.alias("id"), (k % 7).alias("image"), F.lit(1600).alias("width"), F.lit(1200).alias("height"), (512 * (k % 2)).alias("slice_x"),
        (480 * (c("label") % 2)).alias("slice_y"), F.lit(800).alias("slice_side"), "cx", "cy", "w", "h", "logits",
    )


def _edge(at: str, size: str, sign: str, shift: str, limit: int) -> str:
    return f"greatest(0.0E0, least({limit}.0E0, greatest(0.0E0, least(800.0E0, ({at} {sign} 0.5E0 * {size}) * 1.25E0)) + {shift}))"


_SLICED = f"""WITH RECURSIVE {v.SCORES}, s AS (SELECT *, vec_id % 7 AS image, 512 * (vec_id % 2) AS sx, 480 * (label % 2) AS sy, greatest(s0, s1, s2) AS score FROM scores),
e AS (SELECT vec_id AS id, image, CASE WHEN s0 = score THEN 0 WHEN s1 = score THEN 1 ELSE 2 END AS class_id, score, {_edge("cx", "w", "-", "sx", 1600)} AS minx, {_edge("cx", "w", "+", "sx", 1600)} AS maxx,
  {_edge("cy", "h", "-", "sy", 1200)} AS miny, {_edge("cy", "h", "+", "sy", 1200)} AS maxy FROM s WHERE score >= 0.05),
b AS MATERIALIZED (SELECT * FROM e WHERE minx < maxx AND miny < maxy)"""
_WORSE = """SELECT z.id AS lo, a.id AS hi FROM b a JOIN b z ON a.image = z.image AND a.class_id = z.class_id AND (a.score > z.score OR a.score = z.score AND a.id < z.id)
  AND least(a.maxx, z.maxx) > greatest(a.minx, z.minx) AND least(a.maxy, z.maxy) > greatest(a.miny, z.miny)
  WHERE (least(a.maxx, z.maxx) - greatest(a.minx, z.minx)) * (least(a.maxy, z.maxy) - greatest(a.miny, z.miny))
    / greatest(least((a.maxx - a.minx) * (a.maxy - a.miny), (z.maxx - z.minx) * (z.maxy - z.miny)), 1e-10) >= 0.5"""


@query(f"""{_SLICED}, {settled(_WORSE)}, k AS (SELECT b.*, row_number() OVER (PARTITION BY image ORDER BY score DESC, b.id) AS place FROM b LEFT JOIN st ON st.id = b.id WHERE coalesce(s, 1) = 1)
SELECT image, id, class_id, round(score, 6) AS score FROM k WHERE place <= 1000""")
def sliced_detection(spark, d):
    """Greedy suppression depends on its own earlier choices; a plain loop is a test too."""
    return det.sliced(slices_of_scores(spark, d), 640.0, 0.05).select("image", "id", "class_id", F.round("score", 6).alias("score"))


def dedup_tables(spark, d):
    """Boxes, and tiles of 1,010 m that share their rims."""
    b = v.unique_boxes(spark, d)
    t = b.where("(x_km + y_km) % 5 <> 0").select("x_km", "y_km").distinct()
    return b, t.select(
        F.concat_ws("_", "x_km", "y_km").alias("tile"), (c("x_km") * 1000.0 - 5).alias("minx"), (c("x_km") * 1000.0 + 1005.0).alias("maxx"),
        ((c("y_km") - 1) * 1000.0 - 5).alias("miny"), (c("y_km") * 1000.0 + 5).alias("maxy"),
    )


_REPEATED = f"""WITH RECURSIVE {v.BOXES}, {v.UNIQUE}, t AS (SELECT x_km || '_' || y_km AS tile, x_km * 1000.0E0 - 5 AS minx, x_km * 1000.0E0 + 1005 AS maxx, (y_km - 1) * 1000.0E0 - 5 AS miny,
  y_km * 1000.0E0 + 5 AS maxy FROM (SELECT DISTINCT x_km, y_km FROM ub WHERE (x_km + y_km) % 5 <> 0)),
inside AS MATERIALIZED (SELECT ub.id, any_value(class_id) AS class_id, any_value(confidence) AS confidence, any_value(ub.minx) AS minx, any_value(ub.miny) AS miny, any_value(ub.maxx) AS maxx,
  any_value(ub.maxy) AS maxy, list(tile) AS tiles FROM ub JOIN t ON ub.minx <= t.maxx AND t.minx <= ub.maxx AND ub.miny <= t.maxy AND t.miny <= ub.maxy GROUP BY ub.id),
dealt AS (SELECT *, unnest(range(CAST(floor(minx / 50) AS BIGINT), CAST(floor(maxx / 50) AS BIGINT) + 1)) AS gx FROM
  (SELECT *, unnest(range(CAST(floor(miny / 50) AS BIGINT), CAST(floor(maxy / 50) AS BIGINT) + 1)) AS gy FROM inside)),
o AS (SELECT DISTINCT a.id AS a, z.id AS b, coalesce(a.confidence, -1) >= coalesce(z.confidence, -1) AS first,
  (least(a.maxx, z.maxx) - greatest(a.minx, z.minx)) * (least(a.maxy, z.maxy) - greatest(a.miny, z.miny)) AS i, (a.maxx - a.minx) * (a.maxy - a.miny) + (z.maxx - z.minx) * (z.maxy - z.miny) AS sizes
  FROM dealt a JOIN dealt z ON a.gx = z.gx AND a.gy = z.gy AND a.id < z.id AND least(a.maxx, z.maxx) > greatest(a.minx, z.minx) AND least(a.maxy, z.maxy) > greatest(a.miny, z.miny)
  WHERE list_has_any(a.tiles, z.tiles)),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a, b) AS k, a, b, CASE WHEN first THEN b ELSE a END AS loser FROM o WHERE i / (sizes - i) > 0.1)"""


@query(f"""{_REPEATED}, {settled("SELECT p.k AS lo, q.k AS hi FROM p JOIN p q ON q.k < p.k AND (q.loser = p.a OR q.loser = p.b)")},
gone AS (SELECT loser FROM p LEFT JOIN st ON st.id = p.k WHERE coalesce(s, 1) = 1)
SELECT id, class_id, confidence FROM inside WHERE id NOT IN (SELECT loser FROM gone)""")
def extent_dedup(spark, d):
    """A pair counts while neither of it is gone: it stays unless a pair before it that counts took one of its two. A plain loop is a test too."""
    return det.drop_repeated(*dedup_tables(spark, d)).select("id", "class_id", "confidence")


CONFIGS = [
    {"target_classes": ["mound", "pit"], "min_confidence": 0.2, "eps_m": 60.0, "min_cluster_size": 4, "buffer_m": 0.0},
    {"target_classes": ["wall"], "eps_m": 45.0, "min_samples": 2, "min_cluster_size": 3, "output_class_name": "site", "output_geometry": "bounding_box", "min_area_m2": 50.0},
]


def cluster_input(spark, d):
    """Detections on a square of 5 km: box centres, three classes, some without a confidence."""
    p = v.table(spark, d, "orders").groupBy(c("o_orderkey").alias("id")).agg(F.max("o_custkey").alias("k"))
    kinds = F.array(*(F.lit(x) for x in ("mound", "pit", "wall")))
    return p.select(
        "id", F.get(kinds, (c("id") % 3).cast("int")).alias("class_name"), F.when(c("id") % 11 != 0, (c("id") % 10) / 10.0).alias("confidence"),
        ((c("id") * 37) % 5000).cast("double").alias("x"), ((c("k") * 91 + c("id") * 7) % 5000).cast("double").alias("y"),
    )


@query()
def cluster_run(spark, d):
    """Components of core points have no plain SQL at this size; all pairs are the test."""
    shapes, _ = det.run_clusters(cluster_input(spark, d), CONFIGS)
    return shapes.select("class_name", "cluster_id", "nb_detect", F.round("confidence", 6).alias("confidence"), "area_m2", F.size("hull").alias("corners"))
