"""Daily sketches of the reports: patients and gap lengths, merged when a report is asked for.

The exact reports start from all journeys each time. Here every day's new
journeys are folded once into a row per group: their number, the known and set
gap flags, a distinct sketch of the patients and a quantile sketch of the gaps.
A report over any span of days merges those rows, so its cost follows the days
and groups, not the journeys. Counts and rates stay exact; patients and the
median are estimates with a stated error.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from lapsekit.settings import LABEL, MIN_SUPPORT, PATIENT, rate_name

#: Registers of a distinct sketch are 2 to this power; its error is about 1.04 / sqrt of them, three times that at most in 99.7 % of cases.
DISTINCT_BITS = 12
#: Size of a quantile sketch; with 200, the rank of what it gives is off by 1.65 % at most in 99 % of cases.
QUANTILE_SIZE = 200
PATIENT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (DISTINCT_BITS / 2), 0.0165


def daily_sketches(journeys: DataFrame, key: str, *, label: str = LABEL, day: str = "FirstDate") -> DataFrame:
    """One row per day and level of ``key``, to be stored; journeys without a day or a level are rows as well.

    The days of two tables of different journeys can be put under each other;
    ``merged`` makes one row of them where they share a day and level.
    """
    return journeys.groupBy(F.col(day).cast("date").alias("day"), F.col(key).alias("level")).agg(
        F.count(F.lit(1)).alias("journeys"),
        F.count(label).alias("known"),
        F.sum(F.col(label).cast("bigint")).alias("gaps"),
        F.hll_sketch_agg(PATIENT, DISTINCT_BITS).alias("patients"),
        F.kll_sketch_agg_bigint(F.col("MaxGapDays").cast("bigint"), QUANTILE_SIZE).alias("gap_days"),
    )


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """The rows of ``sketches`` merged by some of ``day`` and ``level``."""
    return sketches.groupBy(*by).agg(
        F.sum("journeys").alias("journeys"),
        F.sum("known").alias("known"),
        F.sum("gaps").alias("gaps"),
        F.hll_union_agg("patients").alias("patients"),
        F.kll_merge_agg_bigint("gap_days").alias("gap_days"),
    )


def sketched_report(
    sketches: DataFrame,
    key: str,
    *,
    label: str = LABEL,
    first: date | None = None,
    last: date | None = None,
    min_support: int = MIN_SUPPORT,
) -> DataFrame:
    """Journeys, patients, gap rate and median gap per level over the days from ``first`` to ``last``.

    The columns of the exact report; patients and median are estimates. A level
    without any known gap has no median.
    """
    days = sketches
    if first is not None:
        days = days.filter(F.col("day") >= F.lit(first))
    if last is not None:
        days = days.filter(F.col("day") <= F.lit(last))
    rate = rate_name(label)
    some = F.kll_sketch_get_n_bigint("gap_days") > 0
    return (
        merged(days, "level")
        .filter(F.col("journeys") >= min_support)
        .select(
            F.col("level").alias(key),
            "journeys",
            F.hll_sketch_estimate("patients").alias("patients"),
            F.try_divide(F.col("gaps"), F.col("known")).alias(rate),
            F.when(some, F.kll_sketch_get_quantile_bigint("gap_days", F.lit(0.5))).cast("double").alias("median_max_gap_days"),
        )
        .orderBy(F.desc_nulls_last(rate), key)
    )
