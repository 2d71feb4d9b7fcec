"""Histograms with a fixed number of equal bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The bin width when all values are equal, and the share of a bin
# by which an edge is moved so that a value on the edge falls in the lower bin.
EQUAL_VALUES_WIDTH = 0.1
EDGE_TOLERANCE = 1e-8


def _bin_of(value: Column) -> Column:
    return F.ceil(value / F.col("width") - 0.5 - EDGE_TOLERANCE).cast("bigint")


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows per bin, empty bins kept; with ``by``, per group over shared edges.

    Bins are closed on the right and centred on multiples of the bin width,
    which is the value range over ``bins - 1``. Rows are counted per distinct
    value first, so the only shuffle of the input carries at most one row per
    value and task. Edges, bins and groups all come from those counts, and all
    use ``n``, so that Spark reuses that one shuffle for each of them.
    """
    if bins < 2:
        raise ValueError("a histogram needs at least two bins")
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / (bins - 1))
    edges = (
        counts.agg(
            F.min(column).cast("double").alias("lo"),
            F.max(column).cast("double").alias("hi"),
            F.sum("n").alias("total"),
        )
        .filter(F.col("total") > 0)
        .withColumn("width", F.coalesce(width, F.lit(EQUAL_VALUES_WIDTH)))
    )
    # ``edges`` is a single row, whatever the input.
    placed = counts.crossJoin(F.broadcast(edges)).select(
        *by, _bin_of(F.col(column)).alias("bin"), "n"
    )
    filled = placed.groupBy(*by, "bin").agg(F.sum("n").alias("n")).alias("filled")
    grid = edges.select(
        "width", F.explode(F.sequence(_bin_of(F.col("lo")), _bin_of(F.col("hi")))).alias("bin")
    )
    if by:
        groups = counts.groupBy(*by).agg(F.sum("n").alias("n")).filter(F.col("n") > 0)
        # The grid of one group has as many rows as there are bins.
        grid = groups.select(*by).crossJoin(F.broadcast(grid))
    grid = grid.alias("grid")
    same = F.lit(True)
    for name in (*by, "bin"):
        same = same & F.col(f"grid.{name}").eqNullSafe(F.col(f"filled.{name}"))
    center = F.col("grid.bin")
    return (
        grid.join(filled, same, "left")
        .select(
            *(F.col(f"grid.{name}").alias(name) for name in by),
            center.alias("bin"),
            ((center - 0.5) * F.col("width")).alias("bin_lo"),
            ((center + 0.5) * F.col("width")).alias("bin_hi"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("journeys"),
        )
        .orderBy(*by, "bin")
    )
