"""Label rows of images to map features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.functions import geo, names
from geomill.operators.detections import named_classes
from geomill.operators.lookups import by_stem

#: Size of an image that is not found, and pixel of a tile that is known by its name only.
SIDE, PIXEL, TILE = 2000, 0.5, 1000.0
_PLACE = ["pw", "ph", "x0", "y0"]


def placed(stems: DataFrame, sizes: DataFrame, worlds: DataFrame, transforms: DataFrame) -> DataFrame:
    """stem with width, height, pw, ph, x0, y0 and source: how each label file's image lies on the map.

    stems(stem) are label file names without suffix; sizes(image, width, height) and worlds(image, pw, ph, x0, y0) are those
    of images, named like the label file without _detections; transforms(name, pw, ph, x0, y0) those of source rasters. An
    image's own world file comes first, then the raster's transform (same name, without _detections, a name that begins
    it), then the tile's place by its name. Files that none of these place go.
    """
    known = transforms.select("name", F.struct(*_PLACE).alias("value"))
    d = by_stem(stems.select("stem").distinct(), known).withColumn("image", F.replace("stem", F.lit("_detections"), F.lit("")))
    d = d.join(sizes, "image", "left").join(worlds.select("image", F.struct(*_PLACE).alias("world")), "image", "left")
    at = names.anchor(F.col("stem"))
    named = F.when(at.isNotNull(), F.struct(F.lit(PIXEL).alias("pw"), F.lit(-PIXEL).alias("ph"), at["x"].alias("x0"), (at["y"] + TILE).alias("y0")))
    source = F.when(F.col("world").isNotNull(), "world").when(F.col("value").isNotNull(), "raster").otherwise("name")
    d = d.withColumn("p", F.coalesce("world", "value", named)).where("p is not null")
    return d.select("stem", F.coalesce("width", F.lit(SIDE)).alias("width"), F.coalesce("height", F.lit(SIDE)).alias("height"), "p.*", source.alias("source"))


def features(labels: DataFrame, places: DataFrame, class_names: list[str], colours: dict[str, int] | None = None, offset: int = 0) -> DataFrame:
    """labels(stem, class_id, confidence, cx, cy, w, h) as boxes on the map with tile, class name, colour and confidence bin.

    The tile is the third and fourth part of the file name, else global. A class without a name is classe_<id + 1>; its
    colour is that of its name in `colours`, else its id. Labels of files that are not placed go.
    """
    d = named_classes(labels, class_names, offset).withColumn("class_name", names.class_label(F.col("class_name")))
    d = d.join(places, "stem")
    b = geo.box_to_map(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), {k: F.col(k) for k in ("width", "height", *_PLACE)})
    parts = F.split("stem", "_")
    tile = F.when(F.size(parts) >= 4, F.concat_ws("_", F.get(parts, F.lit(2)), F.get(parts, F.lit(3)))).otherwise("global")
    own = F.create_map(*(F.lit(x) for pair in colours.items() for x in pair))[F.col("class_name")] if colours else F.lit(None).cast("int")
    colour = F.coalesce(own, F.col("class_id") + offset)
    return d.select(
        "stem", "source", tile.alias("tile"), "class_name", "confidence", geo.bucket(F.col("confidence")).alias("conf_bin"),
        geo.bucket_colour(F.col("confidence"), colour).alias("conf_color"), *(e.alias(k) for k, e in b.items()), geo.area(b).alias("area"),
    )
