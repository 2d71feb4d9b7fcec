"""All that scoring new journeys needs: forest, kept levels, tier cuts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lapsekit.operators import evaluate, forest
from lapsekit.operators.lumping import Lumping, kept_table, lumping_of
from lapsekit.settings import FEATURES, JOURNEY, PATIENT


@dataclass(frozen=True)
class Bundle:
    forest: forest.Forest
    lumping: Lumping
    cuts: tuple[float | None, float | None]


def save_bundle(bundle: Bundle, path: str, spark: SparkSession) -> None:
    forest.save_forest(bundle.forest, f"{path}/forest")
    kept_table(bundle.lumping, spark).write.mode("overwrite").parquet(f"{path}/kept_levels")
    cuts = spark.createDataFrame([bundle.cuts], "low double, high double")
    cuts.coalesce(1).write.mode("overwrite").parquet(f"{path}/tier_cuts")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    cuts = spark.read.parquet(f"{path}/tier_cuts").first()
    return Bundle(
        forest.load_forest(spark, f"{path}/forest"),
        lumping_of(spark.read.parquet(f"{path}/kept_levels")),
        (cuts["low"], cuts["high"]),
    )


def score_journeys(bundle: Bundle, journeys: DataFrame) -> DataFrame:
    """Key, patient, label (where known), score and tier of the journeys, by the stored levels and cuts.

    The label may be missing. A journey without one of the features can't be
    scored and is left out, as it is from training.
    """
    label = [bundle.forest.label] if bundle.forest.label in journeys.columns else []
    rows = bundle.lumping.apply(journeys.select(JOURNEY, PATIENT, *label, *FEATURES))
    complete = rows.na.drop("any", subset=list(bundle.forest.features))
    scored = forest.score(bundle.forest, forest.dealt_evenly(complete))
    return evaluate.with_risk_tier(scored.select(JOURNEY, PATIENT, *label, evaluate.SCORE), cuts=bundle.cuts)
