"""Blocks of the plane with what lies around them, each worked on by one call of a kernel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.operators.stages import spread


def touched(low: Column, high: Column, side: float, halo: float = 0.0) -> Column:
    """The blocks of one axis whose surroundings an interval touches, as rows."""
    return F.explode(F.sequence(F.floor((low - halo) / side), F.floor((high + halo) / side)))


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Sorted batches as (key, its rows), without a call of Spark for each."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.zeros(len(pdf), bool)
        for k in keys:
            v = pdf[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(pdf)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            part = pdf.iloc[i:j]
            if held and any(held[0][k].iloc[0] != part[k].iloc[0] for k in keys):
                yield tuple(held[0][k].iloc[0] for k in keys), pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield tuple(held[0][k].iloc[0] for k in keys), pd.concat(held, ignore_index=True)


def by_block(rows: DataFrame, keys: list[str], kernel: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str, order: list[str] = ()) -> DataFrame:
    """kernel(key, rows of the key in order) for every value of the keys, none of which is null."""

    def run(batches):
        held: list[pd.DataFrame] = []
        for key, part in groups(batches, keys):
            held.append(kernel(key, part))
            if sum(map(len, held)) > 20_000 or len(held) > 200:
                yield pd.concat(held, ignore_index=True)
                held = []
        if held:
            yield pd.concat(held, ignore_index=True)

    return spread(rows, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
