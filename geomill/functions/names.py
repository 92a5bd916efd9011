"""Names of tiles, products, layers and models as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(name: Column, i: int, sep: str = "_") -> Column:
    """The i-th part of a name, from 0; null beyond the end."""
    return F.get(F.split(name, sep), F.lit(i))


def tile_xy(name: Column) -> Column:
    """struct(x_km, y_km): third and fourth part of a file name without folder and up to two suffixes; null if not whole numbers."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"(\.[^.]*){1,2}$", "")
    x, y = (part(base, i).try_cast("int") for i in (2, 3))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x_km"), y.alias("y_km")))


def km4(x: Column) -> Column:
    return F.format_string("%04d", x)


def tile_key(x: Column, y: Column) -> Column:
    return F.concat_ws("_", km4(x), km4(y))


def cloud_stem(name: Column) -> Column:
    """A point-cloud file name without .copc.laz or .laz."""
    return F.replace(F.replace(name, F.lit(".copc.laz"), F.lit("")), F.lit(".laz"), F.lit(""))


def repaired(name: Column, x: Column, y: Column) -> Column:
    """A name with fewer than four parts is made from the coordinates."""
    return F.when(F.size(F.split(name, "_")) < 4, F.concat(F.lit("LHD_FXX_"), tile_key(x, y))).otherwise(name)


def whole(value: Column, default: int) -> Column:
    """A number written with comma or point, cut to an integer; the default where it is none."""
    number = F.replace(F.trim(value), F.lit(","), F.lit("."))
    number = F.when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), number.try_cast("double"))
    return F.coalesce(F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("int"), F.lit(default))


def real(value: Column, default: float) -> Column:
    """A number written with comma or point; the default where it is none."""
    number = F.replace(F.trim(value), F.lit(","), F.lit("."))
    return F.coalesce(F.when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), number.try_cast("double")), F.lit(float(default)))


def safe_float(value: Column, default: float) -> Column:
    """Text that is a plain number, else the default; no comma is taken."""
    text = F.trim(value)
    return F.coalesce(F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double")), F.lit(float(default)))


def height_code(h: Column) -> Column:
    """1.7 as 1p7; not above zero is 1.7."""
    return F.replace(F.format_string("%.1f", F.when(h > 0, h).otherwise(F.lit(1.7))), F.lit("."), F.lit("p"))


def product_suffix(product: Column, p: dict[str, Column]) -> Column:
    """The parameters of a relief product as part of its folder name."""
    turns = F.when(p["directions"] < 2, F.lit(16)).otherwise(p["directions"])
    return (
        F.when(product == "M_HS", F.format_string("_D%d_E%d_V%d", turns, p["elevation"], p["ve"]))
        .when(product == "SVF", F.format_string("_R%d_D%d_V%d_N%d", p["radius"], turns, p["ve"], p["noise"]))
        .when(product == "SLO", F.format_string("_U%d_V%d", p["unit"], p["ve"]))
        .when(product == "LD", F.concat(F.format_string("_A%d_Rmin%d_Rmax%d_H", p["angle"], p["min_radius"], p["max_radius"]), height_code(p["observer"]), F.format_string("_V%d", p["ve"])))
        .when(product == "SLRM", F.format_string("_R%d_V%d", p["radius"], p["ve"]))
        .when(product == "VAT", F.format_string("_T%d_B%d", p["terrain"], p["blend"]))
        .otherwise("")
    )


def product_file(product: Column, x: Column, y: Column, suffix: Column, resolution: Column) -> Column:
    """The file name under which a product of a tile is kept."""
    head = F.concat(F.lit("LHD_FXX_"), tile_key(x, y))
    dashed = F.translate(product, "_", "-")
    height = F.replace(F.format_string("%.2f", resolution), F.lit("."), F.lit("M"))
    return (
        F.when(product == "MNT", F.concat(head, F.lit("_MNT_A_"), height, F.lit("_LAMB93_IGN69.tif")))
        .when(product == "DENSITE", F.concat(head, F.lit("_densite_A_LAMB93.tif")))
        .otherwise(F.concat(head, F.lit("_"), dashed, suffix, F.lit("_A_LAMB93.tif")))
    )


def temp_file(product: Column, tile: Column, suffix: Column) -> Column:
    """The file name of a product of a tile before it is cropped."""
    base = F.when(product == "DENSITE", "densite").when(product == "M_HS", "hillshade").when(product == "SLO", "Slope").otherwise(product)
    return F.concat(tile, F.lit("_"), base, suffix, F.lit(".tif"))


def product_folder(product: Column, suffix: Column) -> Column:
    """Where the rasters of a product with its parameters lie."""
    return F.concat(F.lit("results/RVT/"), product, suffix, F.lit("/tif"))


def model_slug(weights: Column) -> Column:
    """The folder of a weights file as a safe name; `unknown` for no path, `model` if nothing is left."""
    folder = F.regexp_extract(F.regexp_replace(weights, r"\\", "/"), r"([^/]+)/[^/]*$", 1)
    return F.when(F.coalesce(F.trim(weights), F.lit("")) == "", F.lit("unknown")).otherwise(
        F.coalesce(F.nullif(F.regexp_replace(folder, r"[^A-Za-z0-9_\-.]", "_"), F.lit("")), F.lit("model"))
    )


def detections_name(image: Column) -> Column:
    return F.concat(F.regexp_replace(image, r"\.[^.]*$", ""), F.lit("_detections.jpg"))


def layer_class(layer: Column) -> Column:
    """Parts from the fourth on."""
    return F.array_join(F.slice(F.split(layer, "_"), 4, 10_000), "_")


def duration(seconds: Column) -> Column:
    """5.0s, 1min 5s, 1h 1min."""
    s = F.floor(seconds).cast("int")
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.format_string("%dmin %ds", F.floor(s / 60).cast("int"), s % 60))
        .otherwise(F.format_string("%dh %dmin", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int")))
    )


def bar(done: Column, total: Column, cells: int = 20) -> Column:
    full = F.floor(cells * done / F.greatest(total, F.lit(1))).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), cells - full))


def masked_password(url: Column) -> Column:
    return F.regexp_replace(url, r"(://[^:/@]+):[^@/]+@", "$1:***@")


def unquoted(text: Column) -> Column:
    """Percent escapes resolved; a plus stays, and text with broken escapes stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


# The forms in which links come.
_V3 = r"urldefense\.com/v3/__(.+?)(?:__;|$)"
_V2 = r"urldefense\.proofpoint\.com/v2/url\?u=([^&]+)"
_SAFE = r"safelinks\.protection\.outlook\.com/?\?url=([^&]+)"
_SEARCH = r"google\.com/url\?[^&]*q=([^&]+)"
_OWN = r"(?i)(https?://data\.geopf\.fr/[^\s\"'<>]+\.(?:laz|las|copc\.laz))"
_CLOUD = r"(?i)(https?://[^\s\"'<>]+\.(?:laz|las|copc\.laz))"


def unwrapped(url: Column) -> Column:
    """The link inside a protected one, the first form that fits; else the link itself, without blanks around it."""
    url = F.regexp_replace(url, r"^\s+|\s+$", "")

    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))

    return F.coalesce(
        found(_V3), unquoted(F.translate(found(_V2), "-_", "%/")), unquoted(found(_SAFE)), unquoted(found(_SEARCH)), found(_OWN), found(_CLOUD), url
    )


def url_file(url: Column) -> Column:
    """The last part of a link's path."""
    return F.element_at(F.split(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/"), -1)


def anchor(name: Column) -> Column:
    """struct(x, y) in metres from the four-digit kilometres of a file name; null if it has none."""
    x, y = (F.regexp_extract(name, r"LHD_FXX_(\d{4})_(\d{4})_", i).try_cast("int") for i in (1, 2))
    return F.when(x.isNotNull(), F.struct((x * 1000.0).alias("x"), (y * 1000.0).alias("y")))


def suffix_of(name: Column) -> Column:
    """The last suffix of a file name with its dot, or nothing."""
    return F.regexp_extract(name, r"[^./\\](\.[^./\\]*)$", 1)


def normalised_raster(name: Column, x: Column, y: Column, product: Column) -> Column:
    """The name of a given raster by its tile; without a tile the name stays."""
    return F.when(x.isNull() | y.isNull(), name).otherwise(F.concat(F.lit("LHD_FXX_"), tile_key(x, y), F.lit("_"), product, F.lit("_A_LAMB93"), suffix_of(name)))


def external_cloud(name: Column, x: Column, y: Column, taken: Column) -> Column:
    """The name of a downloaded cloud by its tile; where that name is taken, with its own stem too."""
    head, end = F.concat(F.lit("IGN_EXT_"), tile_key(x, y)), suffix_of(name)
    stem = F.when(F.length(end) > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    return F.when(taken, F.concat(head, F.lit("_"), stem, end)).otherwise(F.concat(head, end))


def class_label(label: Column) -> Column:
    """A class name without blanks around it."""
    return F.regexp_replace(F.coalesce(label.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def colour_index(code: Column) -> Column:
    """The number of color<number>_...; null if there is none."""
    return F.regexp_extract(code, r"^color(\d+)_", 1).try_cast("int")


def raster_layer(path: Column) -> Column:
    """The folder above the first `tif`, or MNT if that comes first; else index."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    marks = F.transform(parts, lambda p, i: F.when((p == "tif") & (i > 0), F.get(parts, i - 1)).when(p == "MNT", F.lit("MNT")))
    return F.coalesce(F.get(F.filter(marks, lambda m: m.isNotNull()), F.lit(0)), F.lit("index"))


def cluster_name(name: Column, targets: Column) -> Column:
    """A cluster class's own name, or one made of its target classes."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("cluster_"), F.array_join(targets, "_"))).otherwise(name)


def pyramid_levels(levels: Column) -> Column:
    """Whole numbers above 1 of a list written with commas or semicolons; the default levels if there is none."""
    parsed = F.filter(F.transform(F.split(F.coalesce(levels, F.lit("")), "[,;]"), lambda x: F.trim(x).try_cast("int")), lambda x: x > 1)
    return F.when(F.size(parsed) > 0, parsed).otherwise(F.array(*(F.lit(2**i) for i in range(1, 7))))
