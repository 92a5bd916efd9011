"""The four modes of a run, its settings, and the checks before it."""

from __future__ import annotations

import copy
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.functions import names
from geomill.operators import raster

#: Defaults of all settings.
DEFAULTS = {
    "app": {
        "files": {"output_dir": "", "data_mode": "ign_laz", "input_file": "", "local_laz_dir": "", "existing_mnt_dir": "", "existing_rvt_dir": ""},
    },
    "processing": {
        "mnt_resolution": 0.5, "density_resolution": 1.0, "tile_overlap": 20,
        "filter_expression": "Classification = 2 OR Classification = 6 OR Classification = 66 OR Classification = 67 OR Classification = 9",
        "pyramids": {"enabled": True, "levels": [2, 4, 8, 16, 32, 64]},
        "products": {"MNT": True, "DENSITE": False, "M_HS": False, "SVF": False, "SLO": False, "LD": False, "SLRM": False, "VAT": False},
    },
    "computer_vision": {
        "enabled": False, "runs": [], "selected_model": "", "target_rvt": "LD", "confidence_threshold": 0.3, "iou_threshold": 0.5,
        "generate_annotated_images": False, "generate_shapefiles": False, "models_dir": "models",
        "sahi": {"slice_height": 640, "slice_width": 640, "overlap_ratio": 0.2},
    },
    "rvt_params": {
        "mdh": {"num_directions": 16, "sun_elevation": 35, "ve_factor": 1, "save_as_8bit": True},
        "svf": {"noise_remove": 0, "num_directions": 16, "radius": 10, "ve_factor": 1, "save_as_8bit": True},
        "slope": {"unit": 0, "ve_factor": 1, "save_as_8bit": True},
        "ldo": {"angular_res": 15, "min_radius": 10, "max_radius": 20, "observer_h": 1.7, "ve_factor": 1, "save_as_8bit": True},
        "slrm": {"radius": 20, "ve_factor": 1, "save_as_8bit": True},
        "vat": {"terrain_type": 0, "save_as_8bit": True},
    },
}


def settings(own: dict | None) -> dict:
    """Defaults overlaid by one's own values, level by level; a single model of an older form becomes the only run."""

    def overlay(base, over):
        out = copy.deepcopy(base)
        for k, value in over.items():
            out[k] = overlay(out[k], value) if isinstance(value, dict) and isinstance(out.get(k), dict) else copy.deepcopy(value)
        return out

    out = overlay(DEFAULTS, own if isinstance(own, dict) else {})
    vision = out["computer_vision"]
    if isinstance(vision, dict) and not (isinstance(vision.get("runs"), list) and vision["runs"]):
        model = str(vision.get("selected_model") or "").strip()
        vision["runs"] = [{"model": model, "target_rvt": str(vision.get("target_rvt") or "LD").strip()}] if model else []
    return out


@dataclass(frozen=True)
class Check:
    name: str
    ok: bool
    details: str = ""
    critical: bool = True


def path_check(name: str, path: str | None, suffixes: tuple[str, ...] = (), folder: bool = True) -> Check:
    """A path that is named, exists and, with suffixes, holds such files."""
    if not (path or "").strip():
        return Check(name, False, "not set")
    p = Path(path)
    if not (p.is_dir() if folder else p.is_file()):
        return Check(name, False, f"not found: {path}")
    n = sum(f.name.lower().endswith(suffixes) for f in os.scandir(p)) if folder and suffixes else 1
    return Check(name, n > 0, f"{n} files" if folder and suffixes else "")


def may_start(checks: list[Check]) -> bool:
    return not any(c.critical and not c.ok for c in checks)


#: Each product of terrain(col, row, z), cell size and its own settings, and the range that its 8-bit form spans.
PRODUCTS: dict[str, tuple[str, Callable[[DataFrame, float, dict], DataFrame], tuple[float, float]]] = {
    "M_HS": ("mdh", lambda t, r, p: raster.hillshade(t, r, p["num_directions"], p["sun_elevation"], p["ve_factor"]), (0.0, 1.0)),
    "SVF": ("svf", lambda t, r, p: raster.sky_view(t, r, p["radius"], p["num_directions"], p["noise_remove"], p["ve_factor"]), (0.6375, 1.0)),
    "SLO": ("slope", lambda t, r, p: raster.slope(t, r, p["unit"] == 1, p["ve_factor"]), (0.0, 51.0)),
    "LD": ("ldo", lambda t, r, p: raster.local_dominance(t, r, p["min_radius"], p["max_radius"], p["angular_res"], p["observer_h"], p["ve_factor"]), (0.5, 1.8)),
    "SLRM": ("slrm", lambda t, r, p: raster.local_relief(t, p["radius"], p["ve_factor"]), (-2.0, 2.0)),
    "VAT": ("vat", lambda t, r, p: raster.blended(t, r, terrain_type=p["terrain_type"]), (0.0, 1.0)),
}


@dataclass
class Clouds:
    """Points to terrain, density and relief products, as one plan a product."""

    x0: float
    y1: float
    options: dict = field(default_factory=lambda: settings(None))

    def run(self, points: DataFrame) -> dict[str, DataFrame]:
        p = self.options["processing"]
        kept = points.where(p["filter_expression"])
        terrain = raster.mean_height(kept, self.x0, self.y1, p["mnt_resolution"])
        out = {"MNT": terrain.withColumnRenamed("z", "value")} if p["products"].get("MNT") else {}
        if p["products"].get("DENSITE"):
            out["DENSITE"] = raster.density(kept, self.x0, self.y1, p["density_resolution"]).select("col", "row", F.col("n").cast("double").alias("value"))
        return out | Terrain(self.options).run(terrain)


@dataclass
class Terrain:
    """Terrain cells to relief products."""

    options: dict = field(default_factory=lambda: settings(None))

    def run(self, terrain: DataFrame) -> dict[str, DataFrame]:
        p, out = self.options["processing"], {}
        for k, (name, product, span) in PRODUCTS.items():
            if p["products"].get(k):
                own = self.options["rvt_params"][name]
                cells = product(terrain, p["mnt_resolution"], own)
                out[k] = raster.stretched(cells, *span) if own.get("save_as_8bit") else cells
        return out


@dataclass
class Rasters:
    """Relief products that exist: files (path) of one product to their tile names, without a tile by their own name."""

    options: dict = field(default_factory=lambda: settings(None))

    def products(self) -> list[str]:
        """The products that runs ask for, each once, in order."""
        vision = self.options["computer_vision"]
        return list(dict.fromkeys(r.get("target_rvt", vision["target_rvt"]) for r in vision["runs"])) or [vision["target_rvt"]]

    def run(self, files: DataFrame) -> dict[str, DataFrame]:
        name = F.regexp_replace("path", r"^.*[/\\]", "")
        xy = names.tile_xy(name)
        return {p: files.select("path", names.normalised_raster(name, xy["x_km"], xy["y_km"], F.lit(p)).alias("name")) for p in self.products()}


MODES: dict[str, type] = {"ign_laz": Clouds, "local_laz": Clouds, "existing_mnt": Terrain, "existing_rvt": Rasters}


def runner(mode: str | None, *args, **named):
    """A new runner of a mode, whose name may have blanks around it."""
    name = str(mode or "").strip()
    if name not in MODES:
        raise ValueError(f"unknown mode: {mode!r}")
    return MODES[name](*args, **named)
