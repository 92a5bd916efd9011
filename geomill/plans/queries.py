"""Registered queries over the views: each a few operators, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geomill.functions import geo, names
from geomill.operators import detections as det
from geomill.operators import lookups, raster, tiles
from geomill.operators.graph import box_pairs, point_pairs
from geomill.plans import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
X0, Y1 = 800000.0, 6502000.0
CLASS_NAMES = ["mound", "pit", "wall"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def c(name: str):
    return F.col(name)


# ---- label rows to geo features -------------------------------------------------------------------------------


@query(f"""WITH {v.BOXES}
SELECT x_km, y_km, class_id, CASE WHEN confidence < 0.2 THEN '[0:0.2[' WHEN confidence < 0.4 THEN '[0.2:0.4[' WHEN confidence < 0.6 THEN '[0.4:0.6['
    WHEN confidence < 0.8 THEN '[0.6:0.8[' ELSE '[0.8:1]' END AS conf_bin, count(*) AS n, round(sum(confidence * area) / sum(area), 6) AS confidence,
  min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM boxes GROUP BY ALL""")
def label_to_geo_buckets(spark, d):
    b = v.boxes(spark, d).withColumn("conf_bin", geo.bucket(c("confidence")))
    return b.groupBy("x_km", "y_km", "class_id", "conf_bin").agg(
        F.count("*").alias("n"), F.round(F.sum(c("confidence") * c("area")) / F.sum("area"), 6).alias("confidence"),
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
    )


@query(f"WITH {v.BOXES} SELECT id, minx, miny, maxx, maxy FROM boxes")
def label_to_geo(spark, d):
    return v.boxes(spark, d).select("id", "minx", "miny", "maxx", "maxy")


@query(f"""WITH {v.LABELS}, s AS (SELECT id, class_id, CASE WHEN class_id = 3 THEN confidence * 10 ELSE confidence END AS k FROM labels),
u AS (SELECT id, class_id, CASE WHEN k > 1.0 AND k <= 10.0 THEN k / 10.0E0 ELSE k END AS q FROM s)
SELECT id, CASE WHEN q < 0.2 THEN '[0:0.2[' WHEN q < 0.4 THEN '[0.2:0.4[' WHEN q < 0.6 THEN '[0.4:0.6[' WHEN q < 0.8 THEN '[0.6:0.8[' ELSE '[0.8:1]' END AS conf_bin,
  'color' || class_id || '_' || CASE WHEN q < 0.2 THEN 'low' WHEN q < 0.4 THEN 'medium_low' WHEN q < 0.6 THEN 'medium' WHEN q < 0.8 THEN 'medium_high' ELSE 'high' END AS conf_color FROM u""")
def conf_bucket(spark, d):
    k = F.when(c("class_id") == 3, c("confidence") * 10).otherwise(c("confidence"))
    return v.labels(spark, d).select("id", geo.bucket(k).alias("conf_bin"), geo.bucket_colour(k, c("class_id")).alias("conf_color"))


def _shade(i: int) -> str:
    x = f"rgb[{i}]"
    return f"""CAST(floor(CASE WHEN q >= 0.8 THEN {x} * 0.7E0 WHEN q >= 0.6 THEN {x} * 0.85E0 WHEN q >= 0.4 THEN {x} WHEN q >= 0.2 THEN {x} + (255.0E0 - {x}) * 0.35E0
 ELSE {x} + (255.0E0 - {x}) * 0.65E0 END) AS INT)"""


@query(f"""WITH p AS (SELECT DISTINCT l_orderkey % 30 AS k, l_quantity / 50.0E0 AS q FROM lineitem),
b AS (SELECT k, q, CASE k % 12 WHEN 0 THEN [255, 59, 59] WHEN 1 THEN [50, 205, 50] WHEN 2 THEN [30, 144, 255] WHEN 3 THEN [255, 215, 0] WHEN 4 THEN [255, 0, 255]
  WHEN 5 THEN [0, 206, 209] WHEN 6 THEN [255, 140, 0] WHEN 7 THEN [138, 43, 226] WHEN 8 THEN [0, 250, 154] WHEN 9 THEN [255, 20, 147] WHEN 10 THEN [173, 255, 47]
  ELSE [65, 105, 225] END AS rgb FROM p)
SELECT k, q, {_shade(1)} AS r, {_shade(2)} AS g, {_shade(3)} AS b FROM b""")
def conf_colour(spark, d):
    p = v.table(spark, d, "lineitem").select((c("l_orderkey") % 30).alias("k"), (c("l_quantity") / 50.0).alias("q")).distinct()
    return p.select("k", "q", *(geo.shaded(c("k"), c("q"), i).alias(name) for i, name in enumerate("rgb")))


@query(f"""WITH {v.LABELS}, n AS (SELECT *, ['mound', 'pit', 'wall'] AS nm FROM labels)
SELECT coalesce(nm[class_id + 1], 'classe_' || (class_id + 1)) AS class_name, count(*) AS n FROM n GROUP BY 1""")
def class_lookup(spark, d):
    return det.named_classes(v.labels(spark, d), CLASS_NAMES).groupBy("class_name").agg(F.count("*").alias("n"))


@query(f"""WITH {v.LABELS}, o AS (SELECT l_suppkey % 7 AS src, l_linenumber AS class_id FROM lineitem)
SELECT src, CAST(CASE WHEN min(class_id) >= 1 AND NOT bool_or(class_id = 0) AND max(class_id) >= 7 THEN -1 ELSE 0 END AS INT) AS "offset" FROM o GROUP BY src""")
def index_offset(spark, d):
    o = v.table(spark, d, "lineitem").select((c("l_suppkey") % 7).alias("src"), c("l_linenumber").alias("class_id"))
    return det.index_offset(o, 7, ["src"])


@query(f"""WITH {v.BOXES} SELECT x_km, class_id, round(coalesce(sum(coalesce(confidence, 0.5) * area) / nullif(sum(area), 0), 0.5), 6) AS confidence, count(*) AS n
FROM boxes GROUP BY x_km, class_id""")
def weighted_conf(spark, d):
    return det.weighted_confidence(v.boxes(spark, d), ["x_km", "class_id"]).select("x_km", "class_id", F.round("confidence", 6).alias("confidence"), "n")


@query(f"""WITH {v.BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY x_km, y_km, class_id ORDER BY confidence DESC, minx, miny, maxx, maxy) AS k FROM boxes)
SELECT x_km, y_km, class_id, confidence, minx FROM r WHERE k = 1""")
def template_row(spark, d):
    return det.template_rows(v.boxes(spark, d), ["x_km", "y_km", "class_id"], "minx", ["confidence", "minx"])


@query(f"""WITH {v.LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY x_km, y_km ORDER BY confidence DESC, id) AS rank FROM labels)
SELECT DISTINCT x_km, y_km, id, rank FROM r WHERE rank <= 10""")
def topk_per_image(spark, d):
    return det.top_k(v.labels(spark, d), ["x_km", "y_km"], 10, "id").select("x_km", "y_km", "id", F.col("rank").cast("long").alias("rank")).distinct()


@query(f"""WITH {v.LABELS} SELECT class_id, count(*) AS n, count(*) FILTER (confidence >= 0.5) AS kept, count(*) FILTER (confidence < 0.5) AS removed,
  round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM labels GROUP BY class_id""")
def threshold_counts(spark, d):
    g = v.labels(spark, d).groupBy("class_id").agg(
        F.count("*").alias("n"), F.count_if(c("confidence") >= 0.5).alias("kept"), F.count_if(c("confidence") < 0.5).alias("removed")
    )
    return g.withColumn("percent", F.round(100.0 * c("n") / F.sum("n").over(W.partitionBy()), 6))  # a row a class


@query(f"""WITH {v.BOXES} SELECT class_id, round(avg(confidence), 6) AS mean_conf, count(*) FILTER (area >= 60) AS kept, count(*) FILTER (area < 60) AS too_small,
  CAST(round(sum(area)) AS BIGINT) AS total_area FROM boxes GROUP BY class_id""")
def area_split(spark, d):
    return v.boxes(spark, d).groupBy("class_id").agg(
        F.round(F.avg("confidence"), 6).alias("mean_conf"), F.count_if(c("area") >= 60).alias("kept"), F.count_if(c("area") < 60).alias("too_small"),
        F.round(F.sum("area")).cast("long").alias("total_area"),
    )


@query(f"""WITH {v.BOXES}, e AS (SELECT class_id, min(minx) AS x0, min(miny) AS y0, max(maxx) AS x1, max(maxy) AS y1 FROM boxes GROUP BY class_id)
SELECT class_id, x0 - 0.05E0 * (x1 - x0) AS minx, y0 - 0.05E0 * (y1 - y0) AS miny, x1 + 0.05E0 * (x1 - x0) AS maxx, y1 + 0.05E0 * (y1 - y0) AS maxy FROM e""")
def extent(spark, d):
    return lookups.grown_extent(v.boxes(spark, d), ["class_id"], 0.05)


@query(f"""WITH {v.BOXES}, u AS (SELECT id, max(struct_pack(x_km := x_km, y_km := y_km, class_id := class_id, minx := minx, miny := miny, maxx := maxx, maxy := maxy)) AS r FROM boxes GROUP BY id),
b AS (SELECT id, r.* FROM u),
p AS (SELECT a.id AS id_a, z.id AS id_b, (least(a.maxx, z.maxx) - greatest(a.minx, z.minx)) * (least(a.maxy, z.maxy) - greatest(a.miny, z.miny)) AS i,
   (a.maxx - a.minx) * (a.maxy - a.miny) + (z.maxx - z.minx) * (z.maxy - z.miny) AS s
  FROM b a JOIN b z ON a.x_km = z.x_km AND a.y_km = z.y_km AND a.class_id = z.class_id AND a.id < z.id AND a.minx < z.maxx AND z.minx < a.maxx AND a.miny < z.maxy AND z.miny < a.maxy)
SELECT id_a, id_b, round(i / (s - i), 6) AS overlap FROM p WHERE i / (s - i) > 0.1E0""")
def spatial_self_iou(spark, d):
    b = v.unique_boxes(spark, d)
    return det.self_overlaps(b, ["x_km", "y_km", "class_id"], 0.1, 50.0).select("id_a", "id_b", F.round("overlap", 6).alias("overlap"))


@query(f"""WITH {v.BOXES}, u AS (SELECT id, max(struct_pack(x_km := x_km, y_km := y_km, minx := minx, miny := miny, maxx := maxx, maxy := maxy)) AS r FROM boxes GROUP BY id),
b AS (SELECT id, r.* FROM u), t AS (SELECT DISTINCT x_km AS tx, y_km AS ty FROM labels)
SELECT DISTINCT id FROM b JOIN t ON minx >= tx * 1000.0 AND maxx <= tx * 1000.0 + 1000.0 AND miny >= (ty - 1) * 1000.0 AND maxy <= ty * 1000.0""")
def inside_tiles(spark, d):
    b = v.unique_boxes(spark, d)
    t = b.select("x_km", "y_km").distinct()
    t = t.select(
        F.concat_ws("_", "x_km", "y_km").alias("tile"), (c("x_km") * 1000.0).alias("minx"), (c("x_km") * 1000.0 + 1000.0).alias("maxx"),
        ((c("y_km") - 1) * 1000.0).alias("miny"), (c("y_km") * 1000.0).alias("maxy"),
    )
    return det.drop_outside(b, t, 1000.0).select("id")


_META = f"""WITH RECURSIVE {v.BOXES}, {v.UNIQUE}, dealt AS (SELECT *, unnest(range(CAST(floor(minx / 50) AS BIGINT), CAST(floor(maxx / 50) AS BIGINT) + 1)) AS gx FROM
  (SELECT *, unnest(range(CAST(floor(miny / 50) AS BIGINT), CAST(floor(maxy / 50) AS BIGINT) + 1)) AS gy FROM ub))"""


def settled(conflicts: str) -> str:
    """SQL of st(id, s): of conflicts(lo, hi), where hi comes first, a row stays (1) when all before it are gone, and goes (2) when one of them stays."""
    return f"""conf AS MATERIALIZED ({conflicts}), st(id, s) USING KEY (id) AS (
  SELECT DISTINCT hi, 1 FROM conf WHERE hi NOT IN (SELECT lo FROM conf)
  UNION SELECT c.lo, CASE WHEN bool_or(coalesce(h.s = 1, false)) THEN 2 ELSE 1 END FROM conf c LEFT JOIN recurring.st h ON h.id = c.hi
  WHERE c.lo NOT IN (SELECT id FROM recurring.st) GROUP BY c.lo HAVING bool_or(coalesce(h.s = 1, false)) OR count(h.id) = count(*))"""


def labelled(nodes: str, edges: str) -> str:
    """SQL of lab(id, c): c is the smallest id reached over edges(a, b), told in both directions."""
    return f"""edge AS MATERIALIZED ({edges}), lab(id, c) USING KEY (id) AS (SELECT id, id FROM {nodes}
  UNION SELECT e.b, min(l.c) FROM lab l JOIN edge e ON e.a = l.id JOIN recurring.lab k ON k.id = e.b WHERE l.c < k.c GROUP BY e.b)"""


def _both(x: str) -> str:
    return f"least(a.max{x}, z.max{x}) - greatest(a.min{x}, z.min{x})"


_AREAS = "(a.maxx - a.minx) * (a.maxy - a.miny)", "(z.maxx - z.minx) * (z.maxy - z.miny)"
_SUPPRESSED = f"""SELECT DISTINCT z.id AS lo, a.id AS hi FROM dealt a JOIN dealt z ON a.gx = z.gx AND a.gy = z.gy AND a.x_km = z.x_km AND a.y_km = z.y_km AND a.class_id = z.class_id
  AND (a.confidence > z.confidence OR a.confidence = z.confidence AND a.id < z.id) AND {_both("x")} > 0 AND {_both("y")} > 0
  WHERE ({_both("x")}) * ({_both("y")}) / greatest(least({_AREAS[0]}, {_AREAS[1]}), 1e-10) >= 0.5"""


@query(f"{_META}, {settled(_SUPPRESSED)} SELECT ub.id, class_id FROM ub LEFT JOIN st ON st.id = ub.id WHERE coalesce(s, 1) = 1")
def greedy_suppress(spark, d):
    b = v.unique_boxes(spark, d).withColumnRenamed("confidence", "score")
    return det.suppress(b, ["x_km", "y_km", "class_id"]).select("id", "class_id")


_AGREE = f"""SELECT DISTINCT a.id AS a, z.id AS b FROM dealt a JOIN dealt z ON a.gx = z.gx AND a.gy = z.gy AND a.x_km = z.x_km AND a.y_km = z.y_km AND a.class_id = z.class_id
  AND a.id <> z.id AND {_both("x")} > 0 AND {_both("y")} > 0
  WHERE ({_both("x")}) * ({_both("y")}) / ({_AREAS[0]} + {_AREAS[1]} - ({_both("x")}) * ({_both("y")})) > 0.15"""


@query(f"{_META}, {labelled('ub', _AGREE)} SELECT id, c AS instance FROM lab")
def instance_merge(spark, d):
    b = v.unique_boxes(spark, d).withColumn("image", F.concat_ws("_", "x_km", "y_km"))
    return det.instances(b)


def _sites(spark, d):
    p = v.table(spark, d, "orders").groupBy(c("o_orderkey").alias("id")).agg(F.max("o_custkey").alias("k"), F.max("o_totalprice").alias("v"))
    return p.select("id", ((c("id") * 37) % 5000).cast("double").alias("x"), ((c("k") * 91 + c("id") * 7) % 5000).cast("double").alias("y"), (c("v") % 1.0).alias("confidence"))


_SITES = """sites AS (SELECT o_orderkey AS id, CAST((o_orderkey * 37) % 5000 AS DOUBLE) AS x, CAST((max(o_custkey) * 91 + o_orderkey * 7) % 5000 AS DOUBLE) AS y FROM orders GROUP BY o_orderkey)"""


@query(f"""WITH {_SITES} SELECT a.id AS a, count(*) AS n FROM sites a JOIN sites b ON floor(a.x / 30) - floor(b.x / 30) BETWEEN -1 AND 1
 AND b.x BETWEEN a.x - 30 AND a.x + 30 AND b.y BETWEEN a.y - 30 AND a.y + 30 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900 GROUP BY a.id""")
def eps_neighbours(spark, d):
    return point_pairs(_sites(spark, d), 30.0).groupBy("a").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_SITES}, cell AS (SELECT *, floor(x / 60) AS gx, floor(y / 60) AS gy FROM sites),
near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM (SELECT *, gx + i AS hx, gy + j AS hy FROM cell, range(-1, 2) u(i), range(-1, 2) w(j)) a JOIN cell b ON b.gx = hx AND b.gy = hy
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3600),
core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 4),
{labelled("core", "SELECT a, b FROM near WHERE a <> b AND a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)")},
rim AS (SELECT a AS id, min(c) AS c FROM near JOIN lab ON lab.id = near.b GROUP BY a)
SELECT sites.id, coalesce(lab.c, rim.c) AS cluster FROM sites LEFT JOIN lab ON lab.id = sites.id LEFT JOIN rim ON rim.id = sites.id""")
def dbscan(spark, d):
    return det.dbscan(_sites(spark, d), 60.0, 4).select("id", "cluster")


@query()
def cluster_shapes(spark, d):
    members = det.dbscan(_sites(spark, d), 60.0, 4)
    return det.cluster_shapes(members).select("cluster", "nb_detect", "area_m2", "density", F.size("hull").alias("corners"))


# ---- tiles ---------------------------------------------------------------------------------------------------


@query(f"""WITH {v.TILES}, t AS (SELECT filename, string_split(replace(filename, '.copc.laz', ''), '_') AS p FROM tiles)
SELECT filename, CAST(p[3] AS INT) AS x_km, CAST(p[4] AS INT) AS y_km, replace(replace(filename, '.copc.laz', ''), '.laz', '') AS stem, p[3] || '_' || p[4] AS tile FROM t""")
def tile_from_name(spark, d):
    t = v.tiles(spark, d).withColumn("xy", names.tile_xy(c("filename")))
    return t.select("filename", "xy.x_km", "xy.y_km", names.cloud_stem(c("filename")).alias("stem"), names.tile_key(c("xy.x_km"), c("xy.y_km")).alias("tile"))


@query(f"""WITH {v.TILES}, t AS (SELECT filename, CAST(substr(filename, 9, 4) AS INT) AS x_km, CAST(substr(filename, 14, 4) AS INT) AS y_km FROM tiles)
SELECT filename, row_number() OVER (PARTITION BY x_km ORDER BY y_km, filename) AS place FROM t""")
def tile_sort(spark, d):
    t = v.tiles(spark, d).withColumn("xy", names.tile_xy(c("filename")))
    return t.select("filename", F.row_number().over(W.partitionBy("xy.x_km").orderBy("xy.y_km", "filename")).cast("long").alias("place"))


_T = f"""WITH {v.TILES}, t AS (SELECT filename, CAST(substr(filename, 9, 4) AS INT) AS x, CAST(substr(filename, 14, 4) AS INT) AS y FROM tiles),
o AS (SELECT dx, dy, CAST(row_number() OVER (ORDER BY dx, dy) AS INT) AS place FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy) WHERE dx <> 0 OR dy <> 0)"""


@query(f"{_T} SELECT a.filename, place, b.filename AS neighbour FROM t a, o JOIN t b ON b.x = a.x + dx AND b.y = a.y + dy")
def neighbour_join(spark, d):
    return tiles.neighbours(v.tiles(spark, d)).select("filename", "place", "neighbour")


@query(f"""{_T} SELECT a.filename, place, CASE WHEN dx < 0 THEN 1000.0 * b.x + 800 ELSE 1000.0 * b.x END::DOUBLE AS xmin, CASE WHEN dx > 0 THEN 1000.0 * b.x + 200 ELSE 1000.0 * b.x + 1000 END::DOUBLE AS xmax,
 CASE WHEN dy < 0 THEN 1000.0 * b.y - 200 ELSE 1000.0 * (b.y - 1) END::DOUBLE AS ymin, CASE WHEN dy > 0 THEN 1000.0 * (b.y - 1) + 200 ELSE 1000.0 * b.y END::DOUBLE AS ymax
FROM t a, o JOIN t b ON b.x = a.x + dx AND b.y = a.y + dy""")
def neighbour_bounds(spark, d):
    n = tiles.neighbours(v.tiles(spark, d))
    b = geo.neighbour_bounds(c("dx"), c("dy"), c("nx"), c("ny"), geo.margin(F.lit(20)))
    return n.select("filename", "place", b.alias("b")).select("filename", "place", "b.*")


@query(f"""{_T} SELECT filename, 1000.0 * x - 200::DOUBLE AS xmin, 1000.0 * (x + 1) + 200::DOUBLE AS xmax, 1000.0 * (y - 1) - 200::DOUBLE AS ymin, 1000.0 * y + 200::DOUBLE AS ymax FROM t""")
def tile_bounds(spark, d):
    t = v.tiles(spark, d).withColumn("xy", names.tile_xy(c("filename")))
    return t.select("filename", geo.tile_bounds(c("xy.x_km"), c("xy.y_km"), F.lit(200)).alias("b")).select("filename", "b.*")


@query("""WITH p AS (SELECT DISTINCT l_extendedprice * 37 AS q, l_suppkey % 160 AS pct FROM lineitem)
SELECT q, pct, CAST(CASE WHEN abs(q - 1000 * round_even(q / 1000, 0)) <= 5 THEN round_even(q / 1000, 0) ELSE floor(q / 1000) END AS INT) AS km,
 CAST(least(999, greatest(0, round_even(1000.0E0 * pct / 100.0E0, 0))) AS INT) AS margin FROM p""")
def km_index(spark, d):
    p = v.table(spark, d, "lineitem").select((c("l_extendedprice") * 37).alias("q"), (c("l_suppkey") % 160).alias("pct")).distinct()
    return p.select("q", "pct", geo.km_index(c("q")).alias("km"), geo.margin(c("pct")).alias("margin"))


@query(f"""WITH {v.POINTS}, k AS (SELECT classification, min(x) AS a, min(y) AS b, max(x) AS m, max(y) AS n FROM points GROUP BY 1)
SELECT classification, floor(a / 1000) * 1000 AS xmin, (floor(m / 1000) + 1) * 1000 AS xmax, floor(b / 1000) * 1000 AS ymin, (floor(n / 1000) + 1) * 1000 AS ymax FROM k""")
def density_bounds(spark, d):
    k = v.points(spark, d).groupBy("classification").agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("m"), F.max("y").alias("n"))
    return k.select("classification", geo.density_bounds(c("a"), c("b"), c("m"), c("n")).alias("b")).select("classification", "b.*")


_G = f"""WITH {v.POINTS}, g AS (SELECT * FROM points WHERE classification IN (2, 6, 66, 67, 9)),
cells AS (SELECT CAST(floor((x - 800000.0E0) / 20.0E0) AS INT) AS col, CAST(floor((6502000.0E0 - y) / 20.0E0) AS INT) AS "row", count(*) AS n,
  sum(CAST(round_even(z * 100, 0) AS BIGINT)) / count(*) / 100::DOUBLE AS z FROM g GROUP BY 1, 2)"""


@query(f'{_G} SELECT col, "row", n FROM cells')
def density_grid(spark, d):
    return raster.density(v.ground(spark, d), X0, Y1, 20.0)


def _terrain(spark, d):
    return raster.mean_height(v.ground(spark, d), X0, Y1, 20.0)


@query(f'{_G} SELECT col, "row", round(z, 6) AS z FROM cells')
def terrain_mean(spark, d):
    return _terrain(spark, d).select("col", "row", F.round("z", 6).alias("z"))


@query(f"""{_G}, l AS (SELECT unnest([2, 4, 8]) AS level)
SELECT CAST(level AS INT) AS level, CAST(col // level AS INT) AS col, CAST("row" // level AS INT) AS "row", count(*) AS n, round(avg(z) + 1e-7, 4) AS z FROM cells, l GROUP BY ALL""")
def overview_avg(spark, d):
    t = _terrain(spark, d)
    parts = [raster.overview(t, k).select(F.lit(k).alias("level"), "col", "row", "n", F.round(c("z") + 1e-7, 4).alias("z")) for k in (2, 4, 8)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"{_G} SELECT col, \"row\", n FROM cells WHERE col BETWEEN 10 AND 59 AND \"row\" BETWEEN 20 AND 69")
def crop_grid(spark, d):
    return raster.crop(raster.density(v.ground(spark, d), X0, Y1, 20.0), 10, 20, 60, 70)


def _n(dr: int, dc: int) -> str:
    return f"coalesce(max(CASE WHEN k.\"row\" = a.\"row\" + {dr} AND k.col = a.col + {dc} THEN k.z END), max(a.z))"


_HORN = f"""{_G}, horn AS (SELECT a.col, a."row",
 ({_n(-1, 1)} + 2 * {_n(0, 1)} + {_n(1, 1)} - {_n(-1, -1)} - 2 * {_n(0, -1)} - {_n(1, -1)}) / 160.0E0 AS p,
 ({_n(-1, -1)} + 2 * {_n(-1, 0)} + {_n(-1, 1)} - {_n(1, -1)} - 2 * {_n(1, 0)} - {_n(1, 1)}) / 160.0E0 AS q
 FROM cells a JOIN cells k ON k.col BETWEEN a.col - 1 AND a.col + 1 AND k."row" BETWEEN a."row" - 1 AND a."row" + 1 GROUP BY a.col, a."row")"""


@query(f'{_HORN} SELECT col, "row", round(degrees(atan(sqrt(p * p + q * q))), 4) AS value FROM horn')
def slope_3x3(spark, d):
    return raster.slope(_terrain(spark, d), 20.0).select("col", "row", F.round("value", 4).alias("value"))


@query(f"""{_G} SELECT a.col, a."row", round(max(a.z) - avg(k.z) + 1e-7, 4) AS value FROM cells a JOIN cells k ON k.col BETWEEN a.col - 3 AND a.col + 3
  AND k."row" BETWEEN a."row" - 3 AND a."row" + 3 GROUP BY a.col, a."row" """)
def slrm(spark, d):
    return raster.local_relief(_terrain(spark, d), 3).select("col", "row", F.round(c("value") + 1e-7, 4).alias("value"))


def _relief(name, f, sql):
    def run(spark, d):
        return f(_terrain(spark, d)).select("col", "row", F.round("value", 6).alias("value"))

    run.__name__ = name
    query(sql)(run)


_SHADE = """shade AS (SELECT col, "row", sum(greatest(0, (sin(radians(35)) - cos(radians(35)) * (p * sin(2 * pi() * k / 16) + q * cos(2 * pi() * k / 16))) / sqrt(1 + p * p + q * q))) / 16 AS shade
 FROM horn, range(16) u(k) GROUP BY col, "row")"""
_RAYS = """rays AS (SELECT DISTINCT k, -CAST(round_even(d * cos(2 * pi() * k / 16), 0) AS INT) AS r, CAST(round_even(d * sin(2 * pi() * k / 16), 0) AS INT) AS c FROM range(16) u(k), range(1, 11) w(d)),
seen AS (SELECT a.col, a."row", k, max((b.z - a.z) / (sqrt(r * r + c * c) * 20.0E0)) AS t FROM (SELECT * FROM cells, rays) a JOIN cells b ON b.col = a.col + a.c AND b."row" = a."row" + a.r GROUP BY ALL),
sky AS (SELECT cells.col, cells."row", 1 - coalesce(sum(sin(atan(greatest(t, 0)))), 0) / 16 AS sky, 90 - degrees((coalesce(sum(atan(t)), 0) - (16 - count(t)) * pi() / 2) / 16) AS "open"
 FROM cells LEFT JOIN seen ON seen.col = cells.col AND seen."row" = cells."row" GROUP BY 1, 2)"""
_OVER = """ring AS (SELECT d, -CAST(round_even(d * cos(radians(15 * k)), 0) AS INT) AS r, CAST(round_even(d * sin(radians(15 * k)), 0) AS INT) AS c FROM range(24) u(k), range(10, 21) w(d)),
down AS (SELECT a.col, a."row", sum(atan((a.z + 1.7E0 - b.z) / (sqrt(r * r + c * c) * 20.0E0)) * (2 * ln(d + 0.5E0) - 2 * ln(d - 0.5E0))) / sum(2 * ln(d + 0.5E0) - 2 * ln(d - 0.5E0)) AS t
 FROM (SELECT * FROM cells, ring) a JOIN cells b ON b.col = a.col + a.c AND b."row" = a."row" + a.r GROUP BY ALL)"""

_relief("hillshade", lambda t: raster.hillshade(t, 20.0), f'{_HORN}, {_SHADE} SELECT col, "row", round(shade, 6) AS value FROM shade')
_relief("sky_view", lambda t: raster.sky_view(t, 20.0), f'{_G}, {_RAYS} SELECT col, "row", round(sky, 6) AS value FROM sky')
_relief("positive_openness", lambda t: raster.openness(t, 20.0), f'{_G}, {_RAYS} SELECT col, "row", round("open", 6) AS value FROM sky')
_relief(
    "local_dominance", lambda t: raster.local_dominance(t, 20.0),
    f'{_G}, {_OVER} SELECT cells.col, cells."row", round(coalesce(degrees(t), 0), 6) AS value FROM cells LEFT JOIN down ON down.col = cells.col AND down."row" = cells."row"',
)
_relief("relief_blend", lambda t: raster.blended(t, 20.0), f"""{_HORN}, {_SHADE}, {_RAYS},
a AS (SELECT col, "row", shade, 1 - least(1, greatest(0, degrees(atan(sqrt(p * p + q * q))) / 50)) AS steep, least(1, greatest(0, ("open" - 68) / 25)) AS o, least(1, greatest(0, (sky - 0.7E0) / 0.3E0)) AS s
  FROM horn JOIN shade USING (col, "row") JOIN sky USING (col, "row")),
b AS (SELECT *, 0.5E0 * shade + 0.5E0 * steep * shade AS m FROM a), e AS (SELECT *, 0.5E0 * m + 0.5E0 * CASE WHEN m > 0.5 THEN 1 - 2 * (1 - m) * (1 - o) ELSE 2 * m * o END AS n FROM b)
SELECT col, "row", round(0.75E0 * n + 0.25E0 * n * s, 6) AS value FROM e""")


@query()
def terrain_tin(spark, d):
    return raster.terrain(v.ground(spark, d), X0, Y1, 20.0, block=32, reach=4).select("col", "row", F.round("z", 6).alias("z"))


# ---- names, links, numbers -----------------------------------------------------------------------------------


@query(f"""WITH {v.URLS}, u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '/t_' || CAST(page_id AS VARCHAR) || '.laz' WHEN 1 THEN split_part(url, '&', 1) WHEN 2 THEN url || '/LHD_FXX_0840_6520.copc.laz' ELSE url END AS link FROM urls)
SELECT page_id, link, list_last(string_split(regexp_replace(regexp_replace(link, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/')) AS file FROM u""")
def url_unwrap(spark, d):
    u = v.urls(spark, d).select("page_id", names.unwrapped(c("raw")).alias("link"))
    return u.select("page_id", "link", names.url_file(c("link")).alias("file"))


@query("""WITH u AS (SELECT DISTINCT regexp_replace(url, '://', '://user:secret' || page_id % 10 || '@') AS url FROM pages)
SELECT url, regexp_replace(url, '(://[^:/@]+):[^@/]+@', '\\1:***@') AS masked FROM u""")
def mask_password(spark, d):
    u = v.table(spark, d, "pages").select(F.concat(F.split_part("url", F.lit("://"), F.lit(1)), F.lit("://user:secret"), (c("page_id") % 10).cast("string"), F.lit("@"), F.split_part("url", F.lit("://"), F.lit(2))).alias("url"))
    return u.distinct().select("url", names.masked_password(c("url")).alias("masked"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS k, CASE p_partkey % 7 WHEN 0 THEN '_D' || CASE WHEN p_size < 2 THEN 16 ELSE p_size END || '_E35_V1'
 WHEN 1 THEN '_R10_D' || CASE WHEN p_size < 2 THEN 16 ELSE p_size END || '_V1_N0' WHEN 2 THEN '_U0_V1'
 WHEN 3 THEN '_A15_Rmin10_Rmax20_H' || replace(printf('%.1f', CASE WHEN p_size % 3 > 0 THEN p_size % 3 ELSE 1.7 END::DOUBLE), '.', 'p') || '_V1' WHEN 4 THEN '_R' || p_size || '_V1' WHEN 5 THEN '_T0_B0' ELSE '' END AS suffix FROM part""")
def param_suffix(spark, d):
    size = c("p_size")
    one, zero = F.lit(1), F.lit(0)
    p = {
        "directions": size, "elevation": F.lit(35), "ve": one, "radius": F.when(c("p_partkey") % 7 == 1, F.lit(10)).otherwise(size), "noise": zero, "unit": zero,
        "angle": F.lit(15), "min_radius": F.lit(10), "max_radius": F.lit(20), "observer": (size % 3).cast("double"), "terrain": zero, "blend": zero,
    }
    product = F.get(F.array(*(F.lit(x) for x in ("M_HS", "SVF", "SLO", "LD", "SLRM", "VAT", "MNT"))), (c("p_partkey") % 7).cast("int"))
    return v.table(spark, d, "part").select(c("p_partkey").cast("long").alias("k"), names.product_suffix(product, p).alias("suffix"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS k, CASE WHEN p_size % 2 = 0 THEN 'LHD_FXX_' || lpad(CAST(p_size + 800 AS VARCHAR), 4, '0') || '_6520_MNT_A_0M50_LAMB93_IGN69.tif'
 ELSE 'LHD_FXX_' || lpad(CAST(p_size + 800 AS VARCHAR), 4, '0') || '_6520_M-HS_D16_E35_V1_A_LAMB93.tif' END AS file FROM part""")
def product_names(spark, d):
    even = c("p_size") % 2 == 0
    f = names.product_file(F.when(even, "MNT").otherwise("M_HS"), c("p_size") + 800, F.lit(6520), F.lit("_D16_E35_V1"), F.lit(0.5))
    return v.table(spark, d, "part").select(c("p_partkey").cast("long").alias("k"), f.alias("file"))


_NUM = """n AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN replace(CAST(round(value, 2) AS VARCHAR), '.', ',') WHEN 1 THEN CAST(round(value, 2) AS VARCHAR) WHEN 2 THEN 'abc' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE '1d' END AS t FROM events)"""


@query("""WITH n AS (SELECT DISTINCT l_linenumber % 6 AS k, CAST(CAST(l_quantity * 100 AS BIGINT) AS VARCHAR) AS a FROM lineitem),
s AS (SELECT k, a, CASE k WHEN 0 THEN a || ',5' WHEN 1 THEN a || '.25' WHEN 2 THEN 'abc' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE '1d' END AS t FROM n)
SELECT k, a, CAST(CASE WHEN k IN (0, 1) THEN CAST(a AS INT) ELSE 7 END AS INT) AS whole, CASE WHEN k IN (0, 1) THEN CAST(replace(t, ',', '.') AS DOUBLE) ELSE 7.5 END AS "real",
 CASE WHEN k = 1 THEN CAST(t AS DOUBLE) ELSE 0.25E0 END AS safe FROM s""")
def locale_numbers(spark, d):
    n = v.table(spark, d, "lineitem").select((c("l_linenumber") % 6).alias("k"), (c("l_quantity") * 100).cast("long").cast("string").alias("a")).distinct()
    t = F.when(c("k") == 0, F.concat("a", F.lit(",5"))).when(c("k") == 1, F.concat("a", F.lit(".25"))).when(c("k") == 2, "abc").when(c("k") == 3, "").when(c("k") == 5, "1d")
    return n.select("k", "a", names.whole(t, 7).alias("whole"), names.real(t, 7.5).alias("real"), names.safe_float(t, 0.25).alias("safe"))


@query("""WITH s AS (SELECT DISTINCT CAST(floor(l_extendedprice / 3) AS INT) AS t FROM lineitem)
SELECT t, CASE WHEN t < 60 THEN printf('%.1fs', t::DOUBLE) WHEN t < 3600 THEN (t // 60) || 'min ' || (t % 60) || 's' ELSE (t // 3600) || 'h ' || (t % 3600 // 60) || 'min' END AS text,
 repeat('#', CAST(20 * (t % 101) // 100 AS INT)) || repeat('-', CAST(20 - 20 * (t % 101) // 100 AS INT)) AS bar FROM s""")
def duration_text(spark, d):
    s = v.table(spark, d, "lineitem").select(F.floor(c("l_extendedprice") / 3).cast("int").alias("t")).distinct()
    return s.select("t", names.duration(c("t").cast("double")).alias("text"), names.bar(c("t") % 101, F.lit(100)).alias("bar"))


@query("""SELECT event_id, CAST(event_id % 50 AS INT) AS done, 50 AS total, event_type AS status, CAST(round_even(100.0E0 * (event_id % 50) / 50, 0) AS INT) AS percent FROM events""")
def progress_parse(spark, d):
    e = v.table(spark, d, "events")
    line = F.concat(F.lit("progress="), (c("event_id") % 50).cast("string"), F.lit("/50 image=i"), c("event_id").cast("string"), F.lit(" status="), c("event_type"))
    m = e.select("event_id", F.str_to_map(line, F.lit(" "), F.lit("=")).alias("m"))
    at = F.split(F.element_at("m", "progress"), "/")
    done, total = F.get(at, F.lit(0)).cast("int"), F.get(at, F.lit(1)).cast("int")
    return m.select("event_id", done.alias("done"), total.alias("total"), F.element_at("m", "status").alias("status"), F.rint(100.0 * done / F.greatest(F.lit(1), total)).cast("int").alias("percent"))


@query("""WITH p AS (SELECT p_partkey, replace(p_name, ' ', '_') AS n FROM part)
SELECT CAST(p_partkey AS BIGINT) AS k, regexp_replace('m ' || n || '+' || p_partkey % 3, '[^A-Za-z0-9_.-]', '_', 'g') AS slug, n || '_detections.jpg' AS image,
  array_to_string((string_split('a_b_c_' || n, '_'))[4:], '_') AS cls FROM p""")
def model_names(spark, d):
    n = F.replace(c("p_name"), F.lit(" "), F.lit("_"))
    path = F.concat(F.lit("/models/m "), n, F.lit("+"), (c("p_partkey") % 3).cast("string"), F.lit("/best.onnx"))
    return v.table(spark, d, "part").select(
        c("p_partkey").cast("long").alias("k"), names.model_slug(path).alias("slug"), names.detections_name(F.concat(n, F.lit(".tif"))).alias("image"),
        names.layer_class(F.concat(F.lit("a_b_c_"), n)).alias("cls"),
    )


# ---- joins with a preference ---------------------------------------------------------------------------------


@query("""WITH l AS (SELECT event_id, user_id FROM events), j AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_id % 3 = 0)
SELECT l.event_id, coalesce(j.k, -1) AS k FROM l LEFT JOIN j USING (event_id)""")
def json_left_join(spark, d):
    e = v.table(spark, d, "events")
    j = e.where(c("event_id") % 3 == 0).select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    return e.select("event_id").join(j, "event_id", "left").select("event_id", F.coalesce("k", F.lit(-1)).alias("k"))


@query("""WITH s AS (SELECT DISTINCT p_brand || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '_detections' ELSE '_x' || p_size END AS stem FROM part),
t AS (SELECT p_brand AS name, min(p_partkey) AS value FROM part GROUP BY 1)
SELECT stem, coalesce(a.value, b.value, (SELECT min(value) FROM t WHERE starts_with(s.stem, t.name))) AS value
FROM s LEFT JOIN t a ON a.name = s.stem LEFT JOIN t b ON b.name = regexp_replace(s.stem, '_detections$', '')""")
def transform_cascade(spark, d):
    p = v.table(spark, d, "part")
    ending = F.when(c("p_size") % 3 == 0, "").when(c("p_size") % 3 == 1, "_detections").otherwise(F.concat(F.lit("_x"), c("p_size").cast("string")))
    stems = p.select(F.concat("p_brand", ending).alias("stem")).distinct()
    known = p.groupBy(c("p_brand").alias("name")).agg(F.min("p_partkey").alias("value"))
    return lookups.by_stem(stems, known)


@query("""WITH r AS (SELECT p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type LIKE '%STEEL%' THEN 0 WHEN p_type LIKE '%BRASS%' THEN 1 ELSE 2 END, p_partkey) AS k FROM part)
SELECT p_brand, p_partkey FROM r WHERE k = 1""")
def priority_pick(spark, d):
    order = F.when(c("p_type").contains("STEEL"), 0).when(c("p_type").contains("BRASS"), 1).otherwise(2)
    return lookups.first_by(v.table(spark, d, "part"), ["p_brand"], [order, c("p_partkey")], ["p_partkey"])


@query("""WITH done AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01') SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM done)""")
def skip_done(spark, d):
    done = v.table(spark, d, "lineitem").where(c("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")).select(c("l_orderkey").alias("o_orderkey"))
    return v.table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("""WITH f AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN '' ELSE c_name END AS stem FROM customer)
SELECT c_custkey FROM f WHERE (stem = '' OR regexp_full_match(stem, '[0-9]+')) AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def orphans(spark, d):
    k = c("c_custkey")
    f = v.table(spark, d, "customer").select("c_custkey", F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, "").otherwise(c("c_name")).alias("stem"))
    kept = v.table(spark, d, "orders").select(c("o_custkey").alias("c_custkey"))
    return f.where("stem = '' OR stem RLIKE '^[0-9]+$'").join(kept, "c_custkey", "left_anti").select("c_custkey")


@query(f"""WITH {v.LABELS} SELECT class_id, count(*) AS n FROM labels WHERE class_id IN (SELECT r_regionkey FROM region WHERE r_regionkey % 2 = 1) GROUP BY 1""")
def selected_classes(spark, d):
    wanted = v.table(spark, d, "region").where("r_regionkey % 2 = 1").select(c("r_regionkey").alias("class_id"))
    return v.labels(spark, d).join(wanted, "class_id", "left_semi").groupBy("class_id").agg(F.count("*").alias("n"))


@query("SELECT event_type AS status, count(*) AS n, max(event_id) AS last, bool_or(value > 99 AND user_id % 2 = 0) AS critical FROM events GROUP BY 1")
def status_counters(spark, d):
    e = v.table(spark, d, "events")
    return e.groupBy(c("event_type").alias("status")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"), F.bool_or((c("value") > 99) & (c("user_id") % 2 == 0)).alias("critical"))


@query("SELECT p_type AS value, min(p_partkey) AS first_at FROM part GROUP BY 1")
def ordered_distinct(spark, d):
    return lookups.ordered_distinct(v.table(spark, d, "part"), "p_type", "p_partkey")


@query("""WITH a AS (SELECT n_name AS layer, n_nationkey AS k FROM nation), r AS (SELECT r_name AS cls, r_regionkey AS o FROM region UNION ALL SELECT 'IA', 90 UNION ALL SELECT 'AN', 91 UNION ALL SELECT 'FRANCE', 92),
m AS (SELECT layer, cls, row_number() OVER (PARTITION BY layer ORDER BY CASE WHEN layer = cls THEN 0 ELSE 1 END, o) AS p FROM a JOIN r ON instr(lower(layer), lower(cls)) > 0)
SELECT layer, cls FROM a LEFT JOIN (SELECT * FROM m WHERE p = 1) USING (layer)""")
def layer_class(spark, d):
    layers = v.table(spark, d, "nation").select(c("n_name").alias("layer"))
    more = spark.createDataFrame([("IA", 90), ("AN", 91), ("FRANCE", 92)], "cls string, o int")
    classes = v.table(spark, d, "region").select(c("r_name").alias("cls"), c("r_regionkey").alias("o")).union(more)
    return lookups.layer_classes(layers, classes)


# ---- slices and model output ---------------------------------------------------------------------------------


@query("""WITH s AS (SELECT o_orderkey, 600 + o_custkey % 3000 AS w, 600 + o_custkey % 1000 AS h FROM orders),
x AS (SELECT o_orderkey, h, greatest(0, least(w, unnest(range(0, w, 512)) + 640) - 640) AS x0 FROM s),
y AS (SELECT o_orderkey, x0, greatest(0, least(h, unnest(range(0, h, 512)) + 640) - 640) AS y0 FROM x)
SELECT o_orderkey, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, count(*) AS n FROM y GROUP BY ALL""")
def slice_grid(spark, d):
    s = v.table(spark, d, "orders").select("o_orderkey", (600 + c("o_custkey") % 3000).alias("w"), (600 + c("o_custkey") % 1000).alias("h"))
    s = tiles.slices(s, "w", "h", 640, 0.2)
    return s.groupBy("o_orderkey", "x0", "y0").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 640 + 512 * (l_suppkey % 4) AS x1, l_suppkey % 640 + 512 * (l_partkey % 4) AS y1, l_quantity AS w FROM lineitem),
k AS (SELECT l_orderkey, l_linenumber, greatest(0, least(2000, x1)) AS x1, greatest(0, least(2000, y1)) AS y1, greatest(0, least(2000, x1 + 3 * w)) AS x2, greatest(0, least(2000, y1 + 2 * w)) AS y2 FROM b)
SELECT l_orderkey, l_linenumber, count(*) AS n, sum(x2 - x1) AS dx, sum(y2 - y1) AS dy FROM k WHERE x1 < x2 AND y1 < y2 GROUP BY ALL""")
def slice_shift_clip(spark, d):
    li = v.table(spark, d, "lineitem").withColumn("sx", 512 * (c("l_suppkey") % 4)).withColumn("sy", 512 * (c("l_partkey") % 4))
    x, y = c("l_partkey") % 640, c("l_suppkey") % 640
    b = tiles.shifted_clipped(li, {"x1": x, "y1": y, "x2": x + 3 * c("l_quantity"), "y2": y + 2 * c("l_quantity")}, c("sx"), c("sy"), 2000)
    return b.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum(c("x2") - c("x1")).alias("dx"), F.sum(c("y2") - c("y1")).alias("dy"))


@query(f"""WITH {v.SCORES}, s AS (SELECT *, greatest(s0, s1, s2) AS m FROM scores),
b AS (SELECT vec_id, CAST(CASE WHEN s0 = m THEN 0 WHEN s1 = m THEN 1 ELSE 2 END AS INT) AS class_id, m AS conf, greatest(0, cx - w / 2) AS x1, greatest(0, cy - h / 2) AS y1, least(640, cx + w / 2) AS x2, least(640, cy + h / 2) AS y2 FROM s)
SELECT vec_id, class_id, round(conf, 6) AS conf, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM b WHERE conf >= 0.05 AND x1 < x2 AND y1 < y2""")
def yolo_decode(spark, d):
    s = lookups.decode_rows(v.scores(spark, d), 640.0, 0.05)
    return s.select("vec_id", "class_id", F.round("conf", 6).alias("conf"), *(F.round(k, 4).alias(k) for k in ("x1", "y1", "x2", "y2")))


@query(f"""WITH {v.SCORES}, s AS (SELECT *, greatest(s0, s1, s2) AS m FROM scores)
SELECT vec_id, CAST(CASE WHEN s0 = m THEN 0 WHEN s1 = m THEN 1 ELSE 2 END AS INT) - 1 AS class_id, round(1 / (1 + exp(-m)), 6) AS conf FROM s
WHERE w >= 20 AND h >= 20 AND CASE WHEN s0 = m THEN 0 WHEN s1 = m THEN 1 ELSE 2 END >= 1""")
def rfdetr_decode(spark, d):
    s = lookups.decode_queries(v.scores(spark, d), 20.0, 1)
    return s.select("vec_id", "class_id", F.round("conf", 6).alias("conf"))


@query(f"""WITH {v.SCORES}, m AS (SELECT *, greatest(s0, s1, s2) AS m FROM scores), e AS (SELECT vec_id, exp(s0 - m) AS e0, exp(s1 - m) AS e1, exp(s2 - m) AS e2 FROM m),
p AS (SELECT vec_id, greatest(0, e0 / (e0 + e1 + e2) - 0.1E0) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM e)
SELECT vec_id, round(p0, 6) AS p0, round(p1, 6) AS p1, CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INT) AS cls FROM p""")
def softmax_argmax(spark, d):
    p = lookups.class_probabilities(v.scores(spark, d), 0.1)
    return p.select("vec_id", F.round(F.get("p", F.lit(0)), 6).alias("p0"), F.round(F.get("p", F.lit(1)), 6).alias("p1"), geo.argmax(c("p")).alias("cls"))


@query("""WITH l AS (SELECT vec_id % 50 AS pixel, i - 1 AS cls, CAST(embedding[i] AS DOUBLE) AS p FROM embeddings, (SELECT unnest(range(1, 9)) AS i) r),
m AS (SELECT pixel, cls, sum(CAST(round_even(p * 1000000, 0) AS BIGINT)) AS s, count(*) AS n FROM l GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY s DESC, cls) AS k FROM m)
SELECT pixel, CAST(cls AS INT) AS cls, n, round(s / n / 1000000.0E0 + 1e-9, 6) AS p FROM r WHERE k = 1""")
def pixel_vote(spark, d):
    e = v.table(spark, d, "embeddings")
    long = e.select((c("vec_id") % 50).alias("pixel"), F.posexplode(F.slice("embedding", 1, 8)).alias("cls", "p"))
    return lookups.vote(long.select("pixel", "cls", c("p").cast("double").alias("p")))


@query("""SELECT max(abs(a - b)) AS max_diff, round(avg(abs(a - b)), 9) AS mean_diff, bool_and(abs(a - b) <= 1e-4 + 1e-3 * abs(b)) AS close
FROM (SELECT CAST(embedding[1] AS DOUBLE) AS a, round(CAST(embedding[1] AS DOUBLE), 4) AS b FROM embeddings)""")
def close_to(spark, d):
    a = F.get("embedding", F.lit(0)).cast("double")
    return lookups.compared(v.table(spark, d, "embeddings").select(a.alias("a"), F.round(a, 4).alias("b")))


@query("""WITH a AS (SELECT c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS rank, c_acctbal AS a FROM customer),
b AS (SELECT s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS rank, s_acctbal AS b FROM supplier)
SELECT c_nationkey AS k, a.rank, round(a - b, 2) AS diff FROM a JOIN b ON c_nationkey = s_nationkey AND a.rank = b.rank WHERE a.rank <= 20""")
def rank_compare(spark, d):
    a = v.table(spark, d, "customer").select(c("c_nationkey").alias("k"), c("c_acctbal").alias("a"), c("c_custkey").alias("t"))
    b = v.table(spark, d, "supplier").select(c("s_nationkey").alias("k"), c("s_acctbal").alias("b"), c("s_suppkey").alias("t"))
    return lookups.by_rank(a, b, 20).select("k", "rank", F.round(c("a") - c("b"), 2).alias("diff"))
