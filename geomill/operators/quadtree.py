"""Spatial joins over cells that split where they are crowded: a quadtree made by counting, and salt where nothing splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.kernels import counting
from geomill.operators.blocks import by_block
from geomill.operators.graph import cells
from geomill.operators.stages import written

_CELL = ["level", "cell_x", "cell_y"]


def _touched(rows: DataFrame, size: float) -> DataFrame:
    """A row for each cell of the first level that a box touches."""
    d = rows.withColumn("level", F.lit(0)).withColumn("cell_x", F.explode(cells(F.col("minx"), F.col("maxx"), size)))
    return d.withColumn("cell_y", F.explode(cells(F.col("miny"), F.col("maxy"), size)))


def _quarters(rows: DataFrame, side: float) -> DataFrame:
    """The quarters of its cell, of the given side, that a box touches."""

    def halves(cell: str, axis: str) -> Column:
        first, low, high = F.col(cell) * 2, F.floor(F.col(f"min{axis}") / side), F.floor(F.col(f"max{axis}") / side)
        return F.sequence(F.greatest(first, F.least(low, first + 1)), F.least(first + 1, F.greatest(high, first)))

    d = rows.withColumn("level", F.col("level") + 1).withColumn("cell_x", F.explode(halves("cell_x", "x")))
    return d.withColumn("cell_y", F.explode(halves("cell_y", "y")))


def crowded(rows: DataFrame, size: float, most: int, depth: int, keys: list[str] = ()) -> list[DataFrame]:
    """For each level the cells(keys, level, cell_x, cell_y, n) that more than `most` boxes touch, down to the first level without any.

    Only boxes in crowded cells are looked at on the next level, whose cells are half as wide. Counts are aggregated before
    they are shuffled, and the tables are as small as the crowded places are few.
    """
    by = [*keys, *_CELL]
    tree: list[DataFrame] = []
    now = _touched(rows.select(*keys, "minx", "miny", "maxx", "maxy"), size)
    for level in range(depth + 1):
        heavy = written(now.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > most), "crowded")
        if heavy.isEmpty():
            break
        tree.append(heavy)
        now = _quarters(now.join(heavy.drop("n"), by, "left_semi"), size / 2 ** (level + 1))
    return tree


def dealt(rows: DataFrame, tree: list[DataFrame], size: float, most: int, depth: int, spread: Column | None, keys: list[str] = ()) -> DataFrame:
    """rows with level, cell_x, cell_y and salt: one row for each leaf that a box touches.

    A cell of the last level may still be crowded, as by copies of one box: there rows are dealt by `spread`, a whole
    number, to as many salts as keep a part at `most`, or, without it, go to each salt.
    """
    by = [*keys, *_CELL]
    now, out = _touched(rows, size), []
    for level, heavy in enumerate(tree):
        if level == depth:
            parts = F.ceil(F.col("n") / most).cast("int")
            d = now.join(heavy, by, "left").withColumn("parts", F.coalesce(parts, F.lit(1)))
            salt = F.pmod(spread, F.col("parts")).cast("int") if spread is not None else F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
            out.append(d.withColumn("salt", salt).drop("n", "parts"))
            now = None
            break
        out.append(now.join(heavy.drop("n"), by, "left_anti").withColumn("salt", F.lit(0)))
        now = _quarters(now.join(heavy.drop("n"), by, "left_semi"), size / 2 ** (level + 1))
    if now is not None:
        out.append(now.withColumn("salt", F.lit(0)))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def _suffixed(rows: DataFrame, s: str, keys: list[str]) -> DataFrame:
    keep = {*keys, *_CELL, "salt"}
    return rows.select(*(F.col(c).alias(c if c in keep else f"{c}{s}") for c in rows.columns))


def box_pairs(left: DataFrame, right: DataFrame, size: float, keys: list[str] = (), most: int = 20_000, depth: int = 10) -> DataFrame:
    """Pairs of boxes that overlap or touch, as graph.box_pairs gives them, whatever the density of the boxes.

    Cells of `size` that more than `most` boxes of both sides touch are quartered, up to `depth` times, and then salted,
    so no join key holds many more than `most` rows of the left side. Both sides are read once for each level that is
    needed, which is one where no place is crowded. A pair is kept in the leaf with the lower left corner of what it shares.
    """
    both = left.select(*keys, "minx", "miny", "maxx", "maxy").unionByName(right.select(*keys, "minx", "miny", "maxx", "maxy"))
    tree = crowded(both, size, most, depth, keys)
    a = dealt(left, tree, size, most, depth, F.xxhash64(*left.columns), keys)
    b = dealt(right, tree, size, most, depth, None, keys)
    pairs = _suffixed(a, "_a", keys).join(_suffixed(b, "_b", keys), [*keys, *_CELL, "salt"])
    meet = (F.col("minx_a") <= F.col("maxx_b")) & (F.col("minx_b") <= F.col("maxx_a")) & (F.col("miny_a") <= F.col("maxy_b")) & (F.col("miny_b") <= F.col("maxy_a"))
    side = F.lit(size) / F.pow(F.lit(2.0), F.col("level"))
    first = (F.col("cell_x") == F.floor(F.greatest("minx_a", "minx_b") / side)) & (F.col("cell_y") == F.floor(F.greatest("miny_a", "miny_b") / side))
    return pairs.where(meet & first).drop(*_CELL, "salt")


def met(rows: DataFrame, size: float, most: int = 100_000, depth: int = 4) -> DataFrame:
    """(id, n): how many other boxes each of rows(id, box) overlaps or touches, for those that meet any.

    A leaf's boxes are counted together by rank, so the work grows with the boxes and not with the pairs, and a leaf may
    hold any number of boxes. Only boxes of several leaves have their counts added up. Ids are taken to be unique.
    """
    side = {f.name: f.dataType.simpleString() for f in rows.schema}
    tree = crowded(rows, size, most, depth)
    leaves = dealt(rows.select("id", "minx", "miny", "maxx", "maxy"), tree, size, most, len(tree), None).drop("salt")

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        level, cx, cy = key
        wide = size / 2.0**level
        box = pdf[["minx", "miny", "maxx", "maxy"]].to_numpy(float)
        n = counting.met_here(box, cx * wide, cy * wide)
        many = (np.floor(box[:, [0, 2]] / wide) != cx).any(1) | (np.floor(box[:, [1, 3]] / wide) != cy).any(1)
        return pd.DataFrame({"id": pdf["id"], "n": n, "many": many})

    found = written(by_block(leaves, _CELL, count, f"id {side['id']}, n long, many boolean"), "met")
    added = found.where("many").groupBy("id").agg(F.sum("n").alias("n")).unionByName(found.where("not many").select("id", "n"))
    return added.select("id", (F.col("n") - 1).alias("n")).where("n > 0")


def point_pairs(points: DataFrame, eps: float, most: int = 20_000, depth: int = 4) -> DataFrame:
    """Ordered pairs (a, b) of points(id, x, y) at a distance of eps or less, as graph.point_pairs gives them, in crowded places too."""
    here = points.select("id", "x", "y", F.col("x").alias("minx"), F.col("x").alias("maxx"), F.col("y").alias("miny"), F.col("y").alias("maxy"))
    around = points.select("id", "x", "y", (F.col("x") - eps).alias("minx"), (F.col("x") + eps).alias("maxx"), (F.col("y") - eps).alias("miny"), (F.col("y") + eps).alias("maxy"))
    dx, dy = F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")
    pairs = box_pairs(here, around, 2 * eps, most=most, depth=depth)
    return pairs.where(dx * dx + dy * dy <= eps * eps).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
