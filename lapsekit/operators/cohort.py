"""Which journeys an analysis looks at."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from lapsekit.settings import (
    GAP_GROUP_OVER,
    GAP_GROUP_WITHIN,
    MAX_CHARTED_GAP,
    MIN_OBSERVATION_DAYS,
    OBSERVATION_END,
)


def observed(journeys: DataFrame, observation_end: date = OBSERVATION_END) -> DataFrame:
    """Journeys with a first date, and the days they were observed."""
    days = F.date_diff(F.lit(observation_end), F.col("FirstDate"))
    return journeys.filter(F.col("FirstDate").isNotNull()).withColumn("ObservationDays", days)


def eligible(observed_journeys: DataFrame, min_days: int = MIN_OBSERVATION_DAYS) -> DataFrame:
    return observed_journeys.filter(F.col("ObservationDays") >= min_days)


def charted_gaps(journeys: DataFrame, longest: int = MAX_CHARTED_GAP) -> DataFrame:
    """Journeys whose longest gap is known and within the charted range."""
    gap = F.col("MaxGapDays")
    return journeys.filter(gap.isNotNull() & gap.between(0, longest))


def gap_values(journeys: DataFrame) -> DataFrame:
    return charted_gaps(journeys).select("MaxGapDays")


def gap_groups(journeys: DataFrame, threshold: int = 180) -> DataFrame:
    group = F.when(F.col("MaxGapDays") > threshold, GAP_GROUP_OVER).otherwise(GAP_GROUP_WITHIN)
    return charted_gaps(journeys).select("MaxGapDays", group.alias("GapGroup"))
