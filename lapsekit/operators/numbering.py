"""Row numbers in a global order without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsekit.session import stage

_INSIDE = 33  # Spark's increasing ids keep the number within a partition in this many bits


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the given order, as a stored table.

    Rows are ranged by sampled bounds, sorted and numbered within their range;
    the rows of the ranges before are added. Only a count per range meets in
    one place. The number follows from the order alone if it has no ties.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = stage(ranged, "numbered")
    part, inside = F.shiftright("_id", _INSIDE), F.col("_id").bitwiseAND(F.lit((1 << _INSIDE) - 1))
    # One row per range.
    counts = ranged.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    joined = ranged.withColumn("_range", part).join(F.broadcast(before), "_range")
    return joined.select(*df.columns, (F.col("_before") + inside).alias(name))
