"""Variable importance tables: build, rank, name for display."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lapsekit.functions.labels import (
    renamed,
    spaces_for_underscores,
    split_capitals,
    squished,
    title_case,
    trimmed,
)
from lapsekit.settings import FEATURES, LABEL, PREDICTOR_RENAMES


def rate_spread_importance(
    frame: DataFrame, label: str = LABEL, features: Sequence[str] = FEATURES
) -> DataFrame:
    """Importance without a model: how far gap rates differ between a variable's levels.

    It is the variance of the level's rate over all rows, for all variables in
    one pass that sends one row per level and task.
    """
    texts = frame.select(F.col(label).alias("y"), *(F.col(name).cast("string").alias(name) for name in features))
    levels = (
        texts.unpivot("y", list(features), "variable", "level")
        .groupBy("variable", "level")
        .agg(F.count("*").alias("n"), F.sum("y").alias("gaps"))
    )
    # Sum of n * rate^2 and of n * rate per variable give the variance.
    # The product is taken in doubles: it can pass what a bigint holds.
    square = F.sum(F.col("gaps").cast("double") * F.col("gaps") / F.col("n"))
    mean = F.sum("gaps") / F.sum("n")
    return levels.groupBy("variable").agg((square / F.sum("n") - mean * mean).alias("importance"))


def by_importance(importance: DataFrame) -> DataFrame:
    return importance.orderBy(F.desc_nulls_last("importance"), "variable")


def top_importance(importance: DataFrame, k: int = 15) -> DataFrame:
    """The first ``k`` variables, no more even if there are ties."""
    return by_importance(importance).limit(k)


def top_predictors(importance: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` variables with all ties, and their display names.

    The windows run over one row per variable.
    """
    best_first = Window.orderBy(F.desc_nulls_last("importance"))
    in_order = Window.orderBy(F.desc_nulls_last("importance"), "variable")
    from_least = Window.orderBy(F.asc("importance"), F.desc("variable"))
    words = split_capitals(spaces_for_underscores(F.col("variable")))
    return (
        importance.withColumn("place", F.rank().over(best_first))
        .filter(F.col("place") <= k)
        .select(
            "variable",
            "importance",
            title_case(trimmed(words)).alias("title"),
            renamed(squished(title_case(words)), PREDICTOR_RENAMES).alias("display_name"),
            F.row_number().over(in_order).alias("rank"),
            F.row_number().over(from_least).alias("display_order"),
        )
        .orderBy("rank")
    )
