"""A fitted rate model as a table, to score journeys it was not fitted on.

The table holds all that scoring needs: which levels are kept, the smoothed gap
rate of every kept level, the overall rate, and the cuts of the risk tiers. It
is stored, joined and versioned like any other table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lapsekit.operators import evaluate
from lapsekit.operators.lumping import Lumping, kept_table, lumping_of
from lapsekit.operators.scoring import join_small, level_rates
from lapsekit.settings import JOURNEY, LABEL, PATIENT

#: part: ``base`` (value), ``kept`` (variable, level, its journeys if known), ``rate`` (variable, level, value), ``cut`` (level, value).
SCHEMA = "part string, variable string, level string, value double"
LOW, HIGH = "low", "high"


def rate_model(
    train: DataFrame,
    keys: Sequence[str],
    lumping: Lumping,
    cuts: tuple[float | None, float | None],
    label: str = LABEL,
) -> DataFrame:
    """The model of lumped training rows, as rows of ``SCHEMA``."""
    spark = train.sparkSession
    base, rates = level_rates(train, keys, label)
    known = [("base", None, None, base)] + [("cut", None, name, cut) for name, cut in zip((LOW, HIGH), cuts)]
    model = spark.createDataFrame(known, SCHEMA)
    kept = kept_table(lumping, spark).filter(F.col("variable").isin(list(keys)))
    model = model.unionByName(
        kept.select(F.lit("kept").alias("part"), "variable", "level", F.col("journeys").cast("double").alias("value"))
    )
    for key in keys:
        model = model.unionByName(
            rates[key].select(
                F.lit("rate").alias("part"), F.lit(key).alias("variable"), F.col(key).cast("string").alias("level"),
                F.col("rate").alias("value"),
            )
        )
    return model


def score_by_model(model: DataFrame, journeys: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Journey, patient, score and risk tier of every row of ``journeys``, label known or not.

    ``model`` has to be a stored table. Levels it does not keep are lumped, and
    a level without a rate, a missing one included, gets the overall rate.
    """
    known = {(row["part"], row["level"]): row["value"] for row in model.filter("part IN ('base', 'cut')").collect()}
    base = known["base", None]
    lumping = lumping_of(model.filter("part = 'kept'").withColumnRenamed("value", "journeys"), keys)
    rows = lumping.apply(journeys.select(JOURNEY, PATIENT, *keys))
    for key in keys:
        rate = model.filter((F.col("part") == "rate") & (F.col("variable") == key))
        rows = join_small(rows, rate.select(F.col("level").alias(key), F.col("value").alias(f"_{key}")), key)
    total = sum((F.coalesce(F.col(f"_{key}"), F.lit(base)) for key in keys), F.lit(0.0))
    scored = rows.select(JOURNEY, PATIENT, (total / len(keys)).alias(evaluate.SCORE))
    return evaluate.with_risk_tier(scored, cuts=(known["cut", LOW], known["cut", HIGH]))
