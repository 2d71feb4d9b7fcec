"""Exact quantiles of columns with any number of distinct values, in two passes over the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsekit.session import stage

# A sketch's rank is wrong by at most a ten-thousandth of the rows.
SKETCH_ACCURACY = 10_000
# Brackets reach this many rank errors to both sides of the quantile.
REACH = 4
# Distinct values finished on the driver.
MAX_DRIVER_VALUES = 10_000


@dataclass(frozen=True)
class _Bracket:
    lo: float
    hi: float


@dataclass(frozen=True)
class _Summary:
    """What the first pass tells: rows, least and greatest value, a bracket per probability."""

    rows: int
    whole: _Bracket
    brackets: tuple[_Bracket, ...]


def _summary(values: DataFrame, probabilities: Sequence[Fraction]) -> _Summary:
    """First pass. The sketch is folded in every task, so one small row per task is shuffled."""
    reach = REACH / SKETCH_ACCURACY
    asked = [min(max(float(p) + side * reach, 0.0), 1.0) for p in probabilities for side in (-1, 1)]
    row = values.agg(
        F.count(F.lit(1)).alias("rows"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.percentile_approx("value", asked, SKETCH_ACCURACY).alias("near"),
    ).first()
    whole = _Bracket(row["lo"], row["hi"])
    if row["rows"] <= MAX_DRIVER_VALUES:
        return _Summary(row["rows"], whole, (whole,) * len(probabilities))
    near = row["near"]
    brackets = tuple(
        _Bracket(
            near[2 * i] if asked[2 * i] > 0 else whole.lo,
            near[2 * i + 1] if asked[2 * i + 1] < 1 else whole.hi,
        )
        for i in range(len(probabilities))
    )
    return _Summary(row["rows"], whole, brackets)


def _apart(brackets: Sequence[_Bracket]) -> list[_Bracket]:
    """The brackets in order, overlapping ones as one."""
    merged: list[_Bracket] = []
    for b in sorted(brackets, key=lambda b: (b.lo, b.hi)):
        if merged and b.lo <= merged[-1].hi:
            merged[-1] = _Bracket(merged[-1].lo, max(merged[-1].hi, b.hi))
        else:
            merged.append(b)
    return merged


def _region(brackets: Sequence[_Bracket]) -> Column:
    """2 i + 1 inside bracket i, even numbers between them, ascending with the value."""
    passed = [(F.col("value") >= b.lo).cast("int") + (F.col("value") > b.hi).cast("int") for b in brackets]
    return sum(passed, F.lit(0))


def _counted(values: DataFrame, brackets: Sequence[_Bracket]) -> DataFrame:
    """Second pass: rows per region, and per value where the region is a bracket; written once.

    Equal values are counted before the shuffle, so a value that many rows
    have costs one row per task, as does each region between the brackets.
    """
    region = _region(brackets)
    inside = F.when(F.col("region") % 2 == 1, F.col("value"))
    counts = (
        values.withColumn("region", region)
        .groupBy("region", inside.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return stage(counts, "bracket-counts")


def _pick_here(counts: DataFrame, ranks: Sequence[int]) -> dict[int, float]:
    """Values at ``ranks`` among few (value, n), on the driver."""
    rows = sorted((row["value"], row["n"]) for row in counts.collect())
    found, before, wanted = {}, 0, sorted(ranks)
    for value, n in rows:
        while wanted and wanted[0] < before + n:
            found[wanted.pop(0)] = value
        before += n
    return found


def _pick_ranged(counts: DataFrame, ranks: Sequence[int]) -> dict[int, float]:
    """Values at ``ranks`` among many (value, n): ranges of values, then a running sum inside a range."""
    ranged = stage(
        counts.repartitionByRange("value").withColumn("range", F.spark_partition_id()), "ranged-counts"
    )
    # One row per range.
    sizes = ranged.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect()
    held: dict[int, tuple[int, int]] = {}  # rank -> (its range, rows in the ranges before)
    before = 0
    for row in sizes:
        held |= {rank: (row["range"], before) for rank in ranks if before <= rank < before + row["n"]}
        before += row["n"]
    ordered = Window.partitionBy("range").orderBy("value")
    running = (
        ranged.filter(F.col("range").isin(sorted({at for at, _ in held.values()})))
        .withColumn("upto", F.sum("n").over(ordered))
    )
    hit = F.lit(False)
    for rank, (at, start) in held.items():
        hit = hit | ((F.col("range") == at) & (F.col("upto") > rank - start) & (F.col("upto") - F.col("n") <= rank - start))
    # At most one row per rank.
    rows = running.filter(hit).collect()
    return {
        rank: row["value"]
        for rank, (at, start) in held.items()
        for row in rows
        if row["range"] == at and row["upto"] - row["n"] <= rank - start < row["upto"]
    }


def _look_up(values: DataFrame, brackets: Sequence[_Bracket], ranks: Sequence[int]) -> dict[int, float]:
    """Values at those of ``ranks`` (rows before them in sorted order) that the brackets hold."""
    counted = _counted(values, brackets)
    # One row per region.
    regions = {
        row["region"]: row
        for row in counted.groupBy("region").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values")).collect()
    }
    found: dict[int, float] = {}
    before = 0
    for region in sorted(regions):
        size = regions[region]["rows"]
        inner = [rank - before for rank in ranks if before <= rank < before + size]
        if region % 2 == 1 and inner:
            here = counted.filter(F.col("region") == region).select("value", "n")
            pick = _pick_here if regions[region]["values"] <= MAX_DRIVER_VALUES else _pick_ranged
            found |= {before + rank: value for rank, value in pick(here, inner).items()}
        before += size
    return found


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[Fraction]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbouring values.

    The place ``(n - 1) * p`` is split with whole-number arithmetic, so a
    quantile that falls on a value is that value. Nulls and NaN are left out.

    The rows are read twice: a sketch gives each quantile a bracket of values,
    then the rows below the brackets and of each value inside are counted. The
    rest works on those counts, a few ten-thousandths of the rows. Should a
    bracket miss its quantile, which the sketch's bound rules out, the quantile
    is looked up between the least and the greatest value.
    """
    value = F.col(column).cast("double")
    values = df.select(value.alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    probabilities = [Fraction(p) for p in probabilities]
    if not probabilities:
        return []
    summary = _summary(values, probabilities)
    if summary.rows == 0:
        return [None] * len(probabilities)
    places = [(summary.rows - 1) * p for p in probabilities]
    ranks = sorted({rank for place in places for rank in (math.floor(place), math.ceil(place))})
    found = _look_up(values, _apart(summary.brackets), ranks)
    missed = [rank for rank in ranks if rank not in found]
    if missed:
        found |= _look_up(values, [summary.whole], missed)
    results = []
    for place in places:
        low, high = found[math.floor(place)], found[math.ceil(place)]
        results.append(low if low == high else low + (high - low) * float(place - math.floor(place)))
    return results
