"""Incremental re-runs: only what has no result yet is worked on, in batch or as a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def follow(spark: SparkSession, folder: str, schema: str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Apply a step to each new file of a folder once, across restarts, and append what it gives as Parquet."""
    rows = spark.readStream.schema(schema).format(kind).load(folder)
    return step(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
