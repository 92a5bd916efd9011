"""Registered queries that write files of a given form from the tables, in the folder all executors share, and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geomill.operators.stages import shared_dir
from geomill.plans import views as v
from geomill.plans.queries import c, query
from geomill.sources import clouds, fetch, sinks

WINDOW = (800500.0, 6500250.0, 801500.0, 6501750.0)


@query(f"""WITH {v.POINTS} SELECT classification, CAST(floor(x / 250) AS BIGINT) AS col, CAST(floor(y / 250) AS BIGINT) AS "row", count(*) AS n,
  CAST(sum(CAST(round(z * 100000) AS BIGINT)) AS BIGINT) AS z_steps, min(x) AS minx, max(y) AS maxy
FROM points WHERE x BETWEEN {WINDOW[0]!r} AND {WINDOW[2]!r} AND y BETWEEN {WINDOW[1]!r} AND {WINDOW[3]!r} GROUP BY 1, 2, 3""")
def cloud_files(spark, d):
    """All points written as LAS files, of which a window is read by ranges of records."""
    folder = f"{shared_dir(spark)}/clouds-{uuid.uuid4().hex}"
    files = clouds.write(v.points(spark, d), folder, (1.0, 1.0, 0.00001), (800000.0, 6500000.0, 0.0), cell=250.0, most=500_000)
    files.write.format("noop").mode("overwrite").save()
    p = clouds.points(spark, folder, window=WINDOW, records=100_000)
    g = p.groupBy("classification", F.floor(c("x") / 250).alias("col"), F.floor(c("y") / 250).alias("row"))
    return g.agg(F.count("*").alias("n"), F.sum(F.rint(c("z") * 100000).cast("long")).alias("z_steps"), F.min("x").alias("minx"), F.max("y").alias("maxy"))


@query("""WITH s AS (SELECT s_suppkey AS k, 'f' || s_suppkey || '.txt' AS name, octet_length(encode(s_name)) * 3 AS size FROM supplier),
l AS (SELECT k, name, size, 0 AS again FROM s UNION ALL SELECT k, name, size, 1 FROM s WHERE k % 5 = 0)
SELECT name, CAST(again AS INT) AS again, k % 7 <> 0 AS ok, k % 7 <> 0 AND again = 1 AS skipped, CAST(CASE WHEN k % 7 <> 0 AND again = 1 THEN 0 ELSE 1 END AS INT) AS attempts, CAST(CASE WHEN k % 7 <> 0 THEN size END AS BIGINT) AS bytes FROM l""")
def fetch_outcomes(spark, d):
    """A file for each supplier, whose links are fetched; every fifth is listed twice, every seventh has no file."""
    folder, back = (f"{shared_dir(spark)}/{k}-{uuid.uuid4().hex}" for k in ("shelf", "fetched"))
    s = v.table(spark, d, "supplier").select(c("s_suppkey").alias("k"), F.concat(F.lit("f"), c("s_suppkey").cast("string"), F.lit(".txt")).alias("name"), F.repeat("s_name", 3).alias("text"))
    sinks.each(s.where("k % 7 <> 0"), folder).write.format("noop").mode("overwrite").save()
    links = s.select("name", F.explode(F.when(c("k") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    # links of one name are taken in their order, and the doubled stroke sorts before the single one
    links = links.select("name", F.concat(F.lit(folder), F.when(c("again") == 0, F.lit("//")).otherwise(F.lit("/")), c("name")).alias("url"), "again")
    out = fetch.fetched(links, back)
    return out.select("name", (~F.endswith("url", F.concat(F.lit("//"), c("name")))).cast("int").alias("again"), "ok", "skipped", "attempts", "bytes")
