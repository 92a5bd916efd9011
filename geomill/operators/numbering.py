"""Numbers in an order, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geomill.operators.stages import discard, written


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with number, their place from 0 within `by` in ascending order (nulls first), and total, the rows of `by`.

    Rows are dealt by ranges of (by, order) and numbered inside a range; where a range starts in a group is the sum of
    the rows before it. Rows that tie keep the order in which they are read, and are dealt apart.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order, "__tie")]
    first = written(rows.withColumn("__tie", F.monotonically_increasing_id()), "unnumbered")
    dealt = first.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    dealt = written(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranges")
    discard(first)
    group = [F.coalesce(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}), F.lit("")) if by else F.lit("")]
    dealt = dealt.withColumn("__key", group[0])
    starts = dealt.groupBy("__key", "__part").agg(F.min("__at").alias("low"), F.count("*").alias("n"))
    w = W.partitionBy("__key")  # a row for each range, not for each row
    before = F.coalesce(F.sum("n").over(w.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("__key", "__part", (before - F.col("low")).alias("shift"), F.sum("n").over(w).alias("total"))
    out = dealt.join(starts, ["__key", "__part"]).withColumn("number", F.col("__at") + F.col("shift"))
    return out.select(*rows.columns, "number", "total")
