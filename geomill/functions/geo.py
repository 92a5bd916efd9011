"""Arithmetic of tiles, pixels, boxes, confidences and model output as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM = 1000.0
#: The twelve base colours, in order.
PALETTE = [
    (255, 59, 59), (50, 205, 50), (30, 144, 255), (255, 215, 0), (255, 0, 255), (0, 206, 209),
    (255, 140, 0), (138, 43, 226), (0, 250, 154), (255, 20, 147), (173, 255, 47), (65, 105, 225),
]


def margin(percent: Column) -> Column:
    """Tile overlap in metres, 0 to 999; halves go to the even neighbour."""
    return F.least(F.lit(999), F.greatest(F.lit(0), F.rint(KM * percent / 100.0).cast("int")))


def km_index(v: Column) -> Column:
    """The kilometre line within 5 m, else the kilometre below."""
    near = F.rint(v / KM)
    return F.when(F.abs(v - KM * near) <= 5.0, near).otherwise(F.floor(v / KM)).cast("int")


def neighbour_bounds(dx: Column, dy: Column, vx: Column, vy: Column, m: Column) -> Column:
    """The part of neighbour (vx, vy) that lies within m metres of the tile it is (dx, dy) from; vy is a top edge."""
    x0, y1 = KM * vx, KM * vy
    y0 = KM * (vy - 1)
    return F.struct(
        F.when(dx < 0, x0 + KM - m).otherwise(x0).alias("xmin"),
        F.when(dx > 0, x0 + m).otherwise(x0 + KM).alias("xmax"),
        F.when(dy < 0, y1 - m).otherwise(y0).alias("ymin"),
        F.when(dy > 0, y0 + m).otherwise(y1).alias("ymax"),
    )


def tile_bounds(x: Column, y: Column, m: Column) -> Column:
    return F.struct(
        (KM * x - m).alias("xmin"), (KM * (x + 1) + m).alias("xmax"), (KM * (y - 1) - m).alias("ymin"), (KM * y + m).alias("ymax")
    )


def density_bounds(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.struct(
        (F.floor(minx / KM) * KM).alias("xmin"), ((F.floor(maxx / KM) + 1) * KM).alias("xmax"),
        (F.floor(miny / KM) * KM).alias("ymin"), ((F.floor(maxy / KM) + 1) * KM).alias("ymax"),
    )


def box_to_map(cx: Column, cy: Column, w: Column, h: Column, image: dict[str, Column]) -> dict[str, Column]:
    """A relative centre box to map units: image has width, height, pw, ph, x0, y0."""
    x = image["x0"] + cx * image["width"] * image["pw"]
    y = image["y0"] + cy * image["height"] * image["ph"]
    hw = w * image["width"] * F.abs(image["pw"]) / 2.0
    hh = h * image["height"] * F.abs(image["ph"]) / 2.0
    return {"minx": x - hw, "miny": y - hh, "maxx": x + hw, "maxy": y + hh}


def unit_confidence(c: Column) -> Column:
    """Confidences above 1 and up to 10 are tenths."""
    return F.when((c > 1.0) & (c <= 10.0), c / 10.0).otherwise(c)


def bucket(c: Column) -> Column:
    v = unit_confidence(c)
    return (
        F.when(v.isNull(), None).when(v < 0.2, "[0:0.2[").when(v < 0.4, "[0.2:0.4[").when(v < 0.6, "[0.4:0.6[").when(v < 0.8, "[0.6:0.8[").otherwise("[0.8:1]")
    )


def bucket_colour(c: Column, index: Column) -> Column:
    v = unit_confidence(c)
    level = F.when(v < 0.2, "low").when(v < 0.4, "medium_low").when(v < 0.6, "medium").when(v < 0.8, "medium_high").otherwise("high")
    return F.when(v.isNotNull(), F.concat(F.lit("color"), index.cast("string"), F.lit("_"), level))


def base_colour(index: Column, channel: int) -> Column:
    return F.get(F.array(*(F.lit(c[channel]) for c in PALETTE)), F.pmod(index, F.lit(len(PALETTE))).cast("int"))


def shaded(index: Column, c: Column, channel: int) -> Column:
    """The class colour, darker for high and lighter for low confidence, cut to whole numbers."""
    base = base_colour(index, channel).cast("double")
    darker = lambda f: F.floor(base * (1.0 - f))
    lighter = lambda f: F.floor(base + (255.0 - base) * f)
    return F.when(c >= 0.8, darker(0.30)).when(c >= 0.6, darker(0.15)).when(c >= 0.4, F.floor(base)).when(c >= 0.2, lighter(0.35)).otherwise(lighter(0.65)).cast("int")


def area(b: dict[str, Column]) -> Column:
    return (b["maxx"] - b["minx"]) * (b["maxy"] - b["miny"])


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area of the intersection of two boxes."""
    w = F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"])
    h = F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def ios(a: dict[str, Column], b: dict[str, Column]) -> Column:
    less = F.least(area(a), area(b))
    return F.when(less > 0, overlap(a, b) / less).otherwise(0.0)


def box(prefix: str = "", suffix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}{suffix}") for k in ("minx", "miny", "maxx", "maxy")}


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softmax(scores: Column) -> Column:
    """Of an array of doubles, shifted by its maximum."""
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(scores: Column) -> Column:
    """Index of the first greatest element, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def slice_starts(length: Column, size: int, ratio: float) -> Column:
    """Starts of the slices along one axis; the last ones are moved inward."""
    step = size - int(ratio * size)
    if step <= 0:
        raise ValueError("the overlap ratio must be below 1")
    at = F.sequence(F.lit(0), length - 1, F.lit(step))
    return F.transform(at, lambda lo: F.greatest(F.lit(0), F.least(length, lo + size) - size))


def compactness(area: Column, perimeter: Column) -> Column:
    """4 * 3.14159 * area / perimeter^2; 0 without a perimeter."""
    return F.when(perimeter > 0, 4.0 * 3.14159 * area / (perimeter * perimeter)).otherwise(0.0)


def cloud_tile(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The tile that holds the centre of a cloud; its y is the top edge."""
    return F.struct(((minx + maxx) / 2.0 / KM).cast("int").alias("x_km"), (((miny + maxy) / 2.0 / KM).cast("int") + 1).alias("y_km"))


def label_text(class_id: Column, b: dict[str, Column], width: Column, height: Column) -> Column:
    """A label line of a pixel box: class, centre and size relative to the image, six decimals; a 5 in the seventh place rounds up."""
    x, y = (b["x1"] + b["x2"]) / 2.0 / width, (b["y1"] + b["y2"]) / 2.0 / height
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, x, y, (b["x2"] - b["x1"]) / width, (b["y2"] - b["y1"]) / height)
