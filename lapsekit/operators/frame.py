"""The table a model is trained on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lapsekit.operators.lumping import fit_lumping
from lapsekit.settings import FEATURES, JOURNEY, LABEL, LUMP_LIMITS, PATIENT


def model_columns(journeys: DataFrame, label: str = LABEL) -> DataFrame:
    """Keys, label and features of the journeys whose label is known."""
    return journeys.filter(F.col(label).isNotNull()).select(JOURNEY, PATIENT, label, *FEATURES)


def complete_rows(frame: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows with a 0/1 label and no missing feature. Empty text is not missing."""
    known = F.when(F.col(label).isin(0, 1), F.col(label))
    return frame.withColumn(label, known).na.drop("any", subset=[label, *FEATURES])


def model_frame(journeys: DataFrame, label: str = LABEL) -> DataFrame:
    """Lump the categorical features, then drop incomplete rows.

    The level counts include the rows that are dropped afterwards.
    """
    columns = model_columns(journeys, label)
    return complete_rows(fit_lumping(columns, LUMP_LIMITS).apply(columns), label)


def constant_columns(frame: DataFrame, label: str = LABEL) -> DataFrame:
    """One row per model column: is it constant?

    A column is constant when its least and greatest value agree, so one pass
    over the rows with two values per column tells for all, without a distinct.
    """
    names = [label, *FEATURES]
    varies = [
        F.coalesce(F.min(name) < F.max(name), F.lit(False)).cast("int").alias(name) for name in names
    ]
    return (
        frame.agg(*varies)
        .unpivot([], names, "variable", "varies")
        .select("variable", (1 - F.col("varies")).alias("is_constant"))
    )


def varying_features(frame: DataFrame, label: str = LABEL, features: Sequence[str] = FEATURES) -> list[str]:
    """The features that are not constant; a constant label is an error."""
    constant = {row["variable"] for row in constant_columns(frame, label).filter("is_constant = 1").collect()}
    if label in constant:
        raise ValueError(f"{label} has a single value in the model frame: nothing to learn")
    return [name for name in features if name not in constant]
