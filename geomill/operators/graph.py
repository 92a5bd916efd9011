"""Connected components and spatial joins by equal cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.kernels.density import merged
from geomill.operators.stages import discard, written


def _least(e: DataFrame) -> DataFrame:
    """u with its least v, or itself if that is less."""
    return e.groupBy("u").agg(F.min("v").alias("m"))


def _with(e: DataFrame, least: DataFrame) -> DataFrame:
    """e joined to one row for each u. Both sides are dealt anew for the join, so a hub's rows can be split."""
    return e.withColumn("k", F.struct("u")).join(least.select(F.struct("u").alias("k"), "m"), "k").drop("k")


def rooted(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component being the smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), so long chains fold in a logarithmic number
    of rounds. A step is a partial aggregation and an equi-join; every round is written to the shared folder, and the one
    before it removed. Nulls and loops take no part.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = written(e.distinct(), "components")
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both).select("u", F.least("u", "m").alias("m"))
        star = _with(both, low).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = _least(star)
        down = _with(star, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, written(down.union(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        discard(last)
        state = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Edges that one task may join; more take the rounds of `rooted`.
_FEW = 400_000


def linked(edges: DataFrame, few: int = _FEW) -> DataFrame:
    """As rooted, for edges(a, b) of whole numbers or strings that are mostly few: these are joined by one task, in no rounds."""
    kind = edges.schema["a"].dataType.simpleString()
    if kind not in ("int", "bigint", "string"):
        return rooted(edges)
    e = written(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    if e.count() > few:
        return rooted(e)

    def run(batches):
        parts = list(batches)
        if not parts:
            return
        both = pd.concat([*(p["a"] for p in parts), *(p["b"] for p in parts)], ignore_index=True)
        codes, nodes = pd.factorize(both, sort=True)
        half = len(codes) // 2
        label = merged(len(nodes), codes[:half], codes[half:])
        yield pd.DataFrame({"node": nodes, "component": nodes[label]})

    return written(e.repartition(1).mapInPandas(run, f"node {kind}, component {kind}"), "components")


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """nodes(id) with the smallest id that each reaches over edges(a, b): rows (id, component)."""
    found = rooted(edges, rounds).withColumnRenamed("node", "id")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def cells(lo: Column, hi: Column, size: float) -> Column:
    """All cells of one axis that an interval touches."""
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def box_pairs(left: DataFrame, right: DataFrame, size: float, keys: list[str] = ()) -> DataFrame:
    """Pairs of boxes that overlap or touch, columns of the left with suffix _a and of the right with suffix _b.

    Both sides go to every cell they touch and meet by equality of cell and keys; a pair is kept in the first cell it
    shares, so it shows once and no plain inequality join is planned.
    """

    def dealt(df: DataFrame, s: str) -> DataFrame:
        df = df.select(*(F.col(c).alias(c if c in keys else f"{c}{s}") for c in df.columns))
        df = df.withColumn("cell_x", F.explode(cells(F.col(f"minx{s}"), F.col(f"maxx{s}"), size)))
        return df.withColumn("cell_y", F.explode(cells(F.col(f"miny{s}"), F.col(f"maxy{s}"), size)))

    pairs = dealt(left, "_a").join(dealt(right, "_b"), [*keys, "cell_x", "cell_y"])
    meet = (F.col("minx_a") <= F.col("maxx_b")) & (F.col("minx_b") <= F.col("maxx_a")) & (F.col("miny_a") <= F.col("maxy_b")) & (F.col("miny_b") <= F.col("maxy_a"))
    first = (F.col("cell_x") == F.floor(F.greatest("minx_a", "minx_b") / size)) & (F.col("cell_y") == F.floor(F.greatest("miny_a", "miny_b") / size))
    return pairs.where(meet & first).drop("cell_x", "cell_y")


def point_pairs(points: DataFrame, eps: float) -> DataFrame:
    """Ordered pairs (a, b) of points(id, x, y) at a distance of eps or less, each point with itself too."""
    one = points.select(F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.floor(F.col("x") / eps).alias("cx"), F.floor(F.col("y") / eps).alias("cy"))
    around = F.sequence(F.lit(-1), F.lit(1))
    other = points.select(F.col("id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    other = other.withColumn("i", F.explode(around)).withColumn("j", F.explode(around))
    other = other.select("b", "xb", "yb", (F.floor(F.col("xb") / eps) + F.col("i")).alias("cx"), (F.floor(F.col("yb") / eps) + F.col("j")).alias("cy"))
    dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    return one.join(other, ["cx", "cy"]).where(dx * dx + dy * dy <= eps * eps).select("a", "b")
