"""Settings that lie beside a model's weights. They are a few small files, read through Spark so that any store will do."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from geomill.functions.geo import PALETTE
from geomill.operators.detections import CLUSTERING

#: Files of class names, the first that holds any counts; other names of a model's own description.
CLASS_FILES = ("classes.txt", "class_names.txt", "classes.json", "class_names.json")
SLICING = {"slice_height": 640, "slice_width": 640, "overlap_ratio": 0.2}


def beside(spark: SparkSession, folder: str, wanted: tuple[str, ...]) -> dict[str, str]:
    """Texts of the named files of a folder, without a byte order mark; files that are no UTF-8 are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(wanted) + "}").load(folder)
    out = {}
    for r in found.select("path", "content").collect():  # at most one row a wanted name
        try:
            out[r.path.rsplit("/", 1)[-1]] = bytes(r.content).decode("utf-8-sig")
        except UnicodeDecodeError:
            continue
    return out


def class_names(spark: SparkSession, folder: str) -> list[str] | None:
    """Class names of a model in order: lines, a JSON list, or a JSON object by number, whose gaps are classe_<i>."""
    texts = beside(spark, folder, CLASS_FILES)
    for name in CLASS_FILES:
        text = texts.get(name)
        if text is None:
            continue
        if name.endswith(".txt"):
            lines = [x.strip() for x in text.splitlines() if x.strip()]
            if lines:
                return lines
            continue
        try:
            got = json.loads(text)
            if isinstance(got, dict) and got:
                got = [got.get(str(i), f"classe_{i}") for i in range(max(map(int, got)) + 1)]
        except ValueError:
            continue
        if isinstance(got, list) and got:
            return [str(x).strip() for x in got]
    return None


def arguments(spark: SparkSession, folder: str) -> dict:
    """The model's args.yaml; empty where there is none or it does not parse."""
    import yaml

    text = beside(spark, folder, ("args.yaml",)).get("args.yaml")
    try:
        got = yaml.safe_load(text) if text else None
    except yaml.YAMLError:
        got = None
    return got if isinstance(got, dict) else {}


def metadata(spark: SparkSession, folder: str, name: str = "model_metadata.json") -> dict:
    """The JSON object beside the weights; empty where there is none or it does not parse."""
    try:
        got = json.loads(beside(spark, folder, (name,)).get(name, "{}"))
    except ValueError:
        got = {}
    return got if isinstance(got, dict) else {}


def class_colours(args: dict) -> list[int] | None:
    """Palette places of the classes; what is no number is 0."""

    def place(x) -> int:
        try:
            return int(x) % len(PALETTE)
        except (TypeError, ValueError):
            return 0

    own = args.get("class_colors")
    return [place(x) for x in own] if isinstance(own, list) else None


def slicing(args: dict) -> dict:
    """Size and overlap of slices; the defaults where one of them is no number."""
    own = args.get("sahi")
    own = SLICING | {k: own[k] for k in SLICING if k in own} if isinstance(own, dict) else SLICING
    try:
        return {k: type(SLICING[k])(x) for k, x in own.items()}
    except (TypeError, ValueError):
        return dict(SLICING)


def clustering(args: dict) -> list[dict] | None:
    """Settings of cluster classes, whole and named; one alone may stand without a list. None where none is of use."""
    own = args.get("clustering")
    out = []
    for config in [own] if isinstance(own, dict) else own if isinstance(own, list) else []:
        target = config.get("target_classes", config.get("target_class")) if isinstance(config, dict) else None
        target = [target] if isinstance(target, str) else target
        if not isinstance(target, list) or not target:
            continue
        try:
            typed = {k: type(default)(config.get(k, default)) for k, default in CLUSTERING.items()}
        except (TypeError, ValueError):
            return None
        typed["output_class_name"] = typed["output_class_name"] or "cluster_" + "_".join(map(str, target))
        out.append({"target_classes": target, **typed})
    return out or None


def colour_map(models: list[tuple[list[str], list[int] | None]]) -> dict[str, int]:
    """A palette place for each class name over all models(names, colours).

    Colours that models name come first, each place once; the other classes get the next free place, which starts again
    at 0 after the last.
    """
    out: dict[str, int] = {}
    used: set[int] = set()
    for classes, colours in models:
        for name, place in zip(classes, colours or []):
            if name not in out and place % len(PALETTE) not in used:
                out[name] = place % len(PALETTE)
                used.add(out[name])
    after = 0
    for name in (n for classes, _ in models for n in classes):
        if name not in out:
            while after in used:
                after += 1
            out[name] = after % len(PALETTE)
            used.add(out[name])
            after += 1
    return out
