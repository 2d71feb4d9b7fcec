"""How well a score separates journeys with a long gap from the others.

All operators take journeys with a 0/1 label and a ``predicted_probability``,
whatever model it came from.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsekit.functions.labels import level_position, percent_label
from lapsekit.operators.quantiles import exact_quantiles
from lapsekit.session import stage
from lapsekit.settings import CLASS_CUTOFF, JOURNEY, LABEL, LABEL_NAMES, RISK_TIERS, rate_name

SCORE = "predicted_probability"
# Score ranges over which running counts are taken side by side.
SCORE_RANGES = 512


def has_score(score: str = SCORE) -> Column:
    """Neither null nor NaN."""
    return F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))


def predicted_class(score: str = SCORE, cutoff: float = CLASS_CUTOFF) -> Column:
    """Class name of the score; null without a score."""
    return F.when(has_score(score), F.when(F.col(score) >= cutoff, LABEL_NAMES[1]).otherwise(LABEL_NAMES[0]))


def roc_auc(scored: DataFrame, label: str = LABEL, score: str = SCORE) -> DataFrame:
    """Exact area under the ROC curve as one row; equal scores count one half.

    It is the share of (gap, no gap) pairs in which the gap journey has the
    higher score, from running counts over the distinct scores. No window runs
    over all of them: they are cut into ranges of about equal size, each range
    counts on its own, and the totals of the ranges before are added. The cuts
    may be approximate, the result does not depend on them. Rows without a
    score (null or NaN) or without a 0/1 label are left out. Null when one of
    the classes is missing. The counts per score are written once, so that what
    gave the scores runs once.
    """
    by_score = (
        scored.filter(has_score(score) & F.col(label).isin(0, 1))
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(
            F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
            F.count(F.when(F.col(label) == 0, 1)).alias("neg"),
        )
    )
    by_score = stage(by_score, "by-score")
    shares = [i / SCORE_RANGES for i in range(1, SCORE_RANGES)]
    cuts = sorted(set(by_score.approxQuantile("score", shares, 1 / (4 * SCORE_RANGES))))
    if cuts:
        edges = [float("-inf"), *cuts, float("inf")]
        by_score = Bucketizer(splits=edges, inputCol="score", outputCol="range").transform(by_score)
    else:
        by_score = by_score.withColumn("range", F.lit(0.0))

    # One row per range, at most SCORE_RANGES, with the totals before it and overall.
    totals = by_score.groupBy("range").agg(F.sum("pos").alias("range_pos"), F.sum("neg").alias("range_neg"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "range",
        F.coalesce(F.sum("range_neg").over(earlier), F.lit(0)).alias("neg_before"),
        F.sum("range_pos").over(overall).cast("double").alias("p"),
        F.sum("range_neg").over(overall).cast("double").alias("n"),
    )

    inside = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.col("neg_before") + F.coalesce(F.sum("neg").over(inside), F.lit(0))
    # Twice the pairs, as whole numbers: they pass what a bigint can hold.
    twice = F.col("pos").cast("decimal(18,0)") * (2 * lower + F.col("neg")).cast("decimal(19,0)")
    return (
        by_score.join(F.broadcast(starts), "range")
        .select("p", "n", twice.alias("twice"))
        .agg(F.sum("twice").cast("double").alias("twice"), F.max("p").alias("p"), F.max("n").alias("n"))
        .select(F.try_divide(F.col("twice"), 2.0 * F.col("p") * F.col("n")).alias("auc"))
    )


def confusion_matrix(scored: DataFrame, label: str = LABEL, score: str = SCORE) -> DataFrame:
    """Actual and predicted class with their frequency: always four rows.

    Rows without a score have no predicted class and are in none of them.

    Four conditional counts in one pass, then one row per cell.
    """
    predicted = predicted_class(score)
    cells = [(actual, name) for name in LABEL_NAMES.values() for actual in LABEL_NAMES.items()]
    counts = scored.agg(
        *(
            F.count(F.when((F.col(label) == code) & (predicted == guess), 1)).alias(f"c{i}")
            for i, ((code, _), guess) in enumerate(cells)
        )
    )
    rows = F.array(
        *(
            F.struct(F.lit(name).alias("actual"), F.lit(guess).alias("predicted"), F.col(f"c{i}").alias("Freq"))
            for i, ((_, name), guess) in enumerate(cells)
        )
    )
    return counts.select(F.explode(rows).alias("cell")).select("cell.*")


def metrics(
    scored: DataFrame, train_rows: int | DataFrame, label: str = LABEL, score: str = SCORE,
    observation_filter: str = "ObservationDays >= 365",
) -> DataFrame:
    """AUC, accuracy and row counts of the test set, as one row.

    Rows without a score count as test rows only.
    """
    right = F.when(has_score(score), (F.col(score) >= CLASS_CUTOFF).cast("int") == F.col(label))
    counts = scored.agg(F.avg(right.cast("int")).alias("accuracy"), F.count("*").alias("test_rows"))
    if isinstance(train_rows, DataFrame):
        counts = counts.crossJoin(train_rows.agg(F.count("*").alias("train_rows")))
    else:
        counts = counts.withColumn("train_rows", F.lit(train_rows).cast("bigint"))
    return roc_auc(scored, label, score).crossJoin(counts).withColumns(
        {
            "observation_filter": F.lit(observation_filter),
            "removed_first_encounter_year": F.lit(True),
        }
    )


def tier_cuts(scored: DataFrame, score: str = SCORE) -> tuple[float | None, float | None]:
    """Terciles of the score; two passes, so ``scored`` should be a stored table."""
    first, second = exact_quantiles(scored, score, [Fraction(1, 3), Fraction(2, 3)])
    return first, second


def with_risk_tier(
    scored: DataFrame, score: str = SCORE, cuts: tuple[float | None, float | None] | None = None
) -> DataFrame:
    """Add ``risk_group`` by known cuts, else by the terciles of the score over all rows.

    Tiers are cut at values, so equal scores share a tier and tiers may differ
    in size. A row without a score falls through to the last tier.
    """
    first, second = cuts or tier_cuts(scored, score)
    low, medium, high = RISK_TIERS
    tier = (
        F.when(F.col(score) < F.lit(first).cast("double"), low)
        .when(F.col(score) < F.lit(second).cast("double"), medium)
        .otherwise(high)
    )
    return scored.withColumn("risk_group", tier)


def risk_tier_report(tiered: DataFrame, label: str = LABEL, score: str = SCORE) -> DataFrame:
    """Journeys, observed gap rate and mean score per tier, low to high."""
    rate = f"actual_{rate_name(label)}"
    return (
        tiered.groupBy("risk_group")
        .agg(
            F.count("*").alias("journeys"),
            F.avg((F.col(label) == 1).cast("int")).alias(rate),
            F.avg(score).alias("average_predicted_probability"),
        )
        .withColumn("label", percent_label(F.col(rate)))
        .orderBy(level_position(F.col("risk_group"), RISK_TIERS))
    )


def outreach_list(tiered: DataFrame, tier: str = "High", score: str = SCORE) -> DataFrame:
    """Journeys of one tier to contact, highest score first; none without a score."""
    return (
        tiered.filter((F.col("risk_group") == tier) & has_score(score))
        .select(JOURNEY, "PatientDurableKey", score, "risk_group")
        .orderBy(F.desc(score), JOURNEY)
    )
