"""A score from smoothed gap rates, usable where a forest is not needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lapsekit.session import stage
from lapsekit.settings import LABEL

# A level's rate is smoothed as if this many more journeys had the overall rate.
PRIOR_JOURNEYS = 20.0
# A rate table up to this size is given to every task; a larger one is joined.
MAX_LOCAL_LEVELS = 10_000


def join_small(df: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Left join to a lookup, written once and counted: broadcast if it is small, else shuffled."""
    stored = stage(lookup, "lookup")
    return df.join(F.broadcast(stored) if stored.count() <= MAX_LOCAL_LEVELS else stored, on, "left")


def level_rates(train: DataFrame, keys: Sequence[str], label: str = LABEL) -> tuple[float, dict[str, DataFrame]]:
    """The overall gap rate, and per key the smoothed rate of each of its levels (key, rate)."""
    overall = train.agg(F.count(label).alias("n"), F.sum(label).alias("gaps")).first()
    if not overall["n"]:
        raise ValueError("no labelled rows to learn rates from")
    base = overall["gaps"] / overall["n"]
    rate = (F.sum(label) + PRIOR_JOURNEYS * base) / (F.count(label) + PRIOR_JOURNEYS)
    return base, {key: train.filter(F.col(key).isNotNull()).groupBy(key).agg(rate.alias("rate")) for key in keys}


def rate_scores(
    train: DataFrame, rows: DataFrame, keys: Sequence[str], label: str = LABEL
) -> DataFrame:
    """Add ``predicted_probability``: mean over ``keys`` of the level's smoothed train rate.

    A level that train does not hold gets the overall rate.
    """
    base, rates = level_rates(train, keys, label)
    for key in keys:
        rows = join_small(rows, rates[key].withColumnRenamed("rate", f"_{key}"), key)
    total = sum((F.coalesce(F.col(f"_{key}"), F.lit(base)) for key in keys), F.lit(0.0))
    return rows.withColumn("predicted_probability", total / len(keys)).drop(*(f"_{key}" for key in keys))
