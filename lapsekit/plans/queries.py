"""The registered queries: each operator over the star-schema tables of a folder."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType

from lapsekit.functions import labels
from lapsekit.operators import evaluate, forest, ranking
from lapsekit.operators.build import build_journeys
from lapsekit.operators.cohort import eligible, gap_groups, gap_values
from lapsekit.operators.frame import constant_columns, model_columns, model_frame, varying_features
from lapsekit.operators.histogram import histogram
from lapsekit.operators.importance import permutation_importance
from lapsekit.operators.lumping import fit_lumping, lumped_levels
from lapsekit.operators.rate_model import rate_model, score_by_model
from lapsekit.operators.reports import (
    cohort_summary,
    encounter_type_report,
    gap_report,
    gap_stats,
    gap_stats_capped,
    portal_report,
    short_report,
    social_risk_difference,
    social_risk_report,
)
from lapsekit.operators.sampling import mark_split, sample_cap, split_cutoff
from lapsekit.operators.scoring import rate_scores
from lapsekit.operators.sketches import PATIENT_ERROR, RANK_ERROR, daily_sketches, sketched_report
from lapsekit.plans.bundle import Bundle, load_bundle, save_bundle, score_journeys
from lapsekit.plans.store import input_state, stored, stored_journeys
from lapsekit.session import new_path
from lapsekit.settings import (
    GROUPED_HISTOGRAM_BINS,
    HISTOGRAM_BINS,
    JOURNEY,
    LABEL,
    LUMP_LIMITS,
    PATIENT,
    PORTAL_GROUPS_LONG,
    PORTAL_ORDER_LONG,
    PREDICTOR_RENAMES,
    RISK_TIERS,
    SOCIAL_RISK_NAMES,
    SOCIAL_RISK_NAMES_RECORDED,
    rate_name,
)
from lapsekit.sources.csv_reports import read_report, write_report
from lapsekit.sources.star_schema import journey_inputs
from lapsekit.sources.tables import read_table, replace_table, sql_report

# Gaps over 180 days are nearly universal in these tables, so models learn the
# 365-day flag.
MODEL_LABEL = "LongGap365"
SCORE_KEYS = ("FirstDepartmentSpecialty", "FirstEncounterType")
# Size of the registered sample; below the row count of every test scale but the least.
SAMPLE_ROWS = 1_000
FOREST = forest.ForestSettings()
# One registered forest learns the real label; another a label that these two features decide, so that its
# results are known: the first has its level and the second has not.
PLANTED = {"SexAssignedAtBirth": ("F", True), "OmbRace": ("AFRICA", False)}
PLANTED_FOREST = forest.ForestSettings(trees=100)
DIGITS = 9

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(
        *(
            F.round(f.name, DIGITS).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
            for f in df.schema.fields
        )
    )


def eligible_journeys(spark: SparkSession, folder: str) -> DataFrame:
    return eligible(stored_journeys(spark, folder))


_cutoffs: dict[tuple, str] = {}
_forest_lock = threading.RLock()


def model_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The model frame with its split."""
    frame = stored(
        spark, folder, "model_frame", lambda: model_frame(eligible_journeys(spark, folder), MODEL_LABEL)
    )
    key = input_state(spark, folder)
    if key not in _cutoffs:
        _cutoffs[key] = split_cutoff(frame)
    return mark_split(frame, _cutoffs[key])


def rate_scored_test(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows with the smoothed-rate score."""

    def build() -> DataFrame:
        rows = model_rows(spark, folder)
        train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
        return rate_scores(train, test, SCORE_KEYS, MODEL_LABEL)

    return stored(spark, folder, "rate_scored", build)


def rate_tiered_test(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.with_risk_tier(rate_scored_test(spark, folder))


_forests: dict[tuple, forest.Forest] = {}


def planted_label() -> Column:
    return reduce(and_, ((F.col(name) == level) == has for name, (level, has) in PLANTED.items())).cast("int")


def planted_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All model rows, the label replaced by the planted one."""
    return model_rows(spark, folder).withColumn(MODEL_LABEL, planted_label())


def _fitted(spark: SparkSession, folder: str, name: str, rows: DataFrame, settings: forest.ForestSettings) -> forest.Forest:
    key = (*input_state(spark, folder), name)
    with _forest_lock:
        if key not in _forests:
            features = varying_features(rows, MODEL_LABEL)
            _forests[key] = forest.train_forest(rows.filter("split = 'train'"), features, label=MODEL_LABEL, settings=settings)
        return _forests[key]


def planted_forest(spark: SparkSession, folder: str) -> forest.Forest:
    return _fitted(spark, folder, "planted", planted_rows(spark, folder), PLANTED_FOREST)


def real_forest(spark: SparkSession, folder: str) -> forest.Forest:
    return _fitted(spark, folder, "real", model_rows(spark, folder), FOREST)


def planted_scored_test(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        test = planted_rows(spark, folder).filter("split = 'test'")
        return forest.score(planted_forest(spark, folder), forest.dealt_evenly(test))

    return stored(spark, folder, "planted_scored", build)


def forest_scored_test(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows with the score of the forest that learnt the real label."""

    def build() -> DataFrame:
        test = model_rows(spark, folder).filter("split = 'test'")
        return forest.score(real_forest(spark, folder), forest.dealt_evenly(test))

    return stored(spark, folder, "forest_scored", build)


def stored_rate_model(spark: SparkSession, folder: str) -> DataFrame:
    """The rate model of the training rows, its tiers cut at the test rows' scores, as a stored table."""

    def build() -> DataFrame:
        lumping = fit_lumping(model_columns(eligible_journeys(spark, folder), MODEL_LABEL))
        train = model_rows(spark, folder).filter("split = 'train'")
        cuts = evaluate.tier_cuts(rate_scored_test(spark, folder))
        return rate_model(train, SCORE_KEYS, lumping, cuts, MODEL_LABEL)

    return stored(spark, folder, "rate_model", build)


def score_all_journeys(spark: SparkSession, folder: str) -> DataFrame:
    """Every eligible journey by the stored rate model, its label known or not."""
    return score_by_model(stored_rate_model(spark, folder), eligible_journeys(spark, folder), SCORE_KEYS)


def bundle_scored_journeys(spark: SparkSession, folder: str) -> DataFrame:
    """Every eligible journey with all features by a forest that was stored and loaded; the class it predicts."""
    lumping = fit_lumping(model_columns(eligible_journeys(spark, folder), MODEL_LABEL))
    cuts = evaluate.tier_cuts(planted_scored_test(spark, folder))
    path = new_path(spark, "bundle")
    save_bundle(Bundle(planted_forest(spark, folder), lumping, cuts), path, spark)
    scored = score_journeys(load_bundle(spark, path), eligible_journeys(spark, folder).drop(MODEL_LABEL))
    return scored.select(JOURNEY, PATIENT, evaluate.predicted_class().alias("predicted_class"))


def rate_permutation_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Importance of every lumped feature for the rate score on the test rows; zero for those it doesn't use."""
    rows = model_rows(spark, folder)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    score = lambda df: rate_scores(train, df, SCORE_KEYS, MODEL_LABEL)
    return permutation_importance(test, list(LUMP_LIMITS), score, label=MODEL_LABEL)


def scan_journeys(spark: SparkSession, folder: str) -> DataFrame:
    return stored_journeys(spark, folder).select(JOURNEY, PATIENT, "FirstDate", "MaxGapDays", "LongGap180")


def scalar_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The text expressions on journey rows."""
    journeys = eligible_journeys(spark, folder)
    text = F.concat_ws("_", "FirstVisitTypeDescription", "FirstEncounterType", "OmbEthnicity", "FirstDepartmentSpecialty")
    padded = F.concat(F.lit("\t "), F.col("OmbEthnicity"), F.lit("  "), F.col("SmokingStatus"), F.lit(" \n"))
    words = labels.squished(labels.title_case(labels.spaces_for_underscores(text)))
    share = F.col("NumVisitDays") / F.col("ObservationDays")
    return journeys.select(
        JOURNEY,
        labels.truncated(text).alias("truncated"),
        labels.spaces_for_underscores(text).alias("spaced"),
        labels.split_capitals(F.col("FirstDepartmentSpecialty")).alias("capitals_split"),
        labels.trimmed(padded).alias("trimmed"),
        labels.squished(padded).alias("squished"),
        words.alias("titled"),
        labels.renamed(F.col("OmbEthnicity"), PREDICTOR_RENAMES).alias("renamed"),
        labels.percent_label(share).alias("percent"),
        labels.named_codes(F.col("AnySocialRisk"), SOCIAL_RISK_NAMES).alias("risk_name"),
    )


def sink_csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    report = short_report(eligible_journeys(spark, folder), "MyChartStatus")
    path = new_path(spark, "csv")
    write_report(report, path)
    return read_report(spark, path, report.schema)


def sql_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return sql_report(
        eligible_journeys(spark, folder),
        """
        SELECT FirstEncounterType, COUNT(*) AS journeys, AVG(LongGap180) AS long_gap_180_rate
        FROM {journeys} GROUP BY FirstEncounterType HAVING COUNT(*) >= 50
        ORDER BY long_gap_180_rate DESC
        """,
    )


SKETCHED_FROM, SKETCHED_TO = date(1995, 2, 1), date(1995, 4, 30)


def stored_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """A row per day and first encounter type, folded once from the eligible journeys."""
    return stored(
        spark, folder, "daily_sketches", lambda: daily_sketches(eligible_journeys(spark, folder), "FirstEncounterType")
    )


def sketched_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """The sketched report, and whether its estimates are within their stated errors of the exact values."""
    journeys = eligible_journeys(spark, folder)
    report = sketched_report(stored_sketches(spark, folder), "FirstEncounterType")
    key, gap, middle = F.col("FirstEncounterType"), F.col("MaxGapDays"), F.col("median_max_gap_days")
    exact = journeys.groupBy(key.alias("_key")).agg(F.count_distinct(PATIENT).alias("_patients"))
    # A row per type.
    ranks = journeys.join(F.broadcast(report.select(key.alias("_key"), "median_max_gap_days")), key.eqNullSafe(F.col("_key")))
    ranks = ranks.filter(gap.isNotNull()).groupBy("_key").agg(
        F.avg((gap < middle).cast("int")).alias("_below"), F.avg((gap <= middle).cast("int")).alias("_upto")
    )
    checked = exact.join(ranks, exact["_key"].eqNullSafe(ranks["_key"])).drop(ranks["_key"])
    return report.join(checked, key.eqNullSafe(F.col("_key"))).select(
        key, "journeys", rate_name(LABEL),
        (F.abs(F.col("patients") / F.col("_patients") - 1) <= PATIENT_ERROR).alias("patients_close"),
        ((F.col("_below") <= 0.5 + RANK_ERROR) & (F.col("_upto") >= 0.5 - RANK_ERROR)).alias("median_close"),
    )


def sketched_span(spark: SparkSession, folder: str) -> DataFrame:
    """Journeys and rates of three months, merged from their days."""
    report = sketched_report(
        stored_sketches(spark, folder), "FirstEncounterType", first=SKETCHED_FROM, last=SKETCHED_TO, min_support=1
    )
    return report.select("FirstEncounterType", "journeys", rate_name(LABEL))


def replaced_table(spark: SparkSession, folder: str) -> DataFrame:
    """The observed table is replaced by the eligible rows while it is read: what the reader and the next one see."""
    path = new_path(spark, "replaced")
    before = replace_table(stored_journeys(spark, folder).select(JOURNEY, "ObservationDays"), path)
    replace_table(eligible(read_table(spark, path)), path)
    seen = before.withColumn("version", F.lit("before")).unionByName(read_table(spark, path).withColumn("version", F.lit("after")))
    return seen.groupBy("version").agg(F.count(F.lit(1)).alias("journeys"), F.min("ObservationDays").alias("least_days"))


def importance_of_rates(spark: SparkSession, folder: str) -> DataFrame:
    # Rounded before ranking, so that ties are ties in any order of summation.
    return rounded(ranking.rate_spread_importance(model_rows(spark, folder), MODEL_LABEL))


def planted_metrics(spark: SparkSession, folder: str) -> DataFrame:
    train = planted_rows(spark, folder).filter("split = 'train'")
    return evaluate.metrics(planted_scored_test(spark, folder), train, MODEL_LABEL)


def forest_metrics(spark: SparkSession, folder: str) -> DataFrame:
    train = model_rows(spark, folder).filter("split = 'train'")
    return evaluate.metrics(forest_scored_test(spark, folder), train, MODEL_LABEL)


def planted_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Every tier with its rate where the label's share fixes it: the outer ones, which hold a single class."""
    rate = f"actual_{rate_name(MODEL_LABEL)}"
    tiers = evaluate.risk_tier_report(evaluate.with_risk_tier(planted_scored_test(spark, folder)), MODEL_LABEL)
    every = Window.partitionBy(F.lit(0))  # three rows
    return tiers.select(
        "risk_group", F.sum("journeys").over(every).alias("journeys_of_all"), F.when(F.col("risk_group") != RISK_TIERS[1], F.col(rate)).alias(rate)
    )


def forest_tiers(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.risk_tier_report(evaluate.with_risk_tier(forest_scored_test(spark, folder)), MODEL_LABEL)


def planted_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Every feature, and whether it is one of as many most important ones as decide the label."""
    test = planted_rows(spark, folder).filter("split = 'test'")
    found = forest.permutation_importance(planted_forest(spark, folder), test)
    best_first = Window.orderBy(F.desc("importance"))  # a row per feature
    return found.select("variable", (F.rank().over(best_first) <= len(PLANTED)).alias("is_decisive"))


def _on_eligible(report: Callable[..., DataFrame], *args, **options) -> Query:
    return lambda spark, folder: report(eligible_journeys(spark, folder), *args, **options)


def _on_test_scores(report: Callable[..., DataFrame]) -> Query:
    return lambda spark, folder: report(rate_scored_test(spark, folder), MODEL_LABEL)


REGISTRY: dict[str, Query] = {
    "build_journeys": lambda spark, folder: build_journeys(journey_inputs(spark, folder)),
    "scan_journeys": scan_journeys,
    "observed_base": stored_journeys,
    "eligible": eligible_journeys,
    "gap_values": _on_eligible(gap_values),
    "gap_groups": _on_eligible(gap_groups),
    "cohort_summary": _on_eligible(cohort_summary),
    "gap_by_type": _on_eligible(gap_report, "FirstEncounterType"),
    "gap_by_specialty": _on_eligible(gap_report, "FirstDepartmentSpecialty"),
    "gap_by_visit_type": _on_eligible(gap_report, "FirstVisitTypeDescription", min_support=10),
    "gap_by_type_short": _on_eligible(encounter_type_report),
    "gap_by_portal": _on_eligible(portal_report),
    "gap_by_portal_long": _on_eligible(portal_report, PORTAL_GROUPS_LONG, PORTAL_ORDER_LONG),
    "gap_by_social_risk": _on_eligible(social_risk_report),
    "gap_by_social_risk_recorded": _on_eligible(social_risk_report, SOCIAL_RISK_NAMES_RECORDED),
    "social_risk_diff": _on_eligible(social_risk_difference),
    "gap_stats": _on_eligible(gap_stats),
    "gap_stats_capped": _on_eligible(gap_stats_capped),
    "gap_histogram": lambda spark, folder: histogram(
        gap_values(eligible_journeys(spark, folder)), "MaxGapDays", HISTOGRAM_BINS
    ),
    "gap_histogram_grouped": lambda spark, folder: histogram(
        gap_groups(eligible_journeys(spark, folder)), "MaxGapDays", GROUPED_HISTOGRAM_BINS, by=["GapGroup"]
    ),
    "sql_by_type": sql_by_type,
    "gap_by_type_sketched": sketched_by_type,
    "gap_by_type_of_days": sketched_span,
    "observed_replaced": replaced_table,
    "scalar_labels": scalar_labels,
    "lump_categories": lambda spark, folder: lumped_levels(
        model_columns(eligible_journeys(spark, folder), MODEL_LABEL)
    ),
    "model_frame": lambda spark, folder: model_frame(eligible_journeys(spark, folder), MODEL_LABEL),
    "constant_columns": lambda spark, folder: constant_columns(model_rows(spark, folder), MODEL_LABEL),
    "train_test_split": lambda spark, folder: model_rows(spark, folder).select(JOURNEY, "split"),
    "sample_cap": lambda spark, folder: sample_cap(model_rows(spark, folder), SAMPLE_ROWS).select(JOURNEY),
    "rate_scores": lambda spark, folder: rate_scored_test(spark, folder).select(
        JOURNEY, MODEL_LABEL, evaluate.SCORE
    ),
    "auc": _on_test_scores(evaluate.roc_auc),
    "metrics": lambda spark, folder: evaluate.metrics(
        rate_scored_test(spark, folder), model_rows(spark, folder).filter("split = 'train'"), MODEL_LABEL
    ),
    "confusion_matrix": _on_test_scores(evaluate.confusion_matrix),
    "risk_tiers": lambda spark, folder: evaluate.risk_tier_report(rate_tiered_test(spark, folder), MODEL_LABEL),
    "outreach_list": lambda spark, folder: evaluate.outreach_list(rate_tiered_test(spark, folder)),
    "rate_importance": importance_of_rates,
    "top_k_importance": lambda spark, folder: ranking.top_importance(importance_of_rates(spark, folder)),
    "top_predictors": lambda spark, folder: ranking.top_predictors(importance_of_rates(spark, folder)),
    "score_all_journeys": score_all_journeys,
    "outreach_all_journeys": lambda spark, folder: evaluate.outreach_list(score_all_journeys(spark, folder)),
    "rate_permutation_importance": rate_permutation_importance,
    "rf_train_score": planted_metrics,
    "scored_journeys": lambda spark, folder: planted_scored_test(spark, folder).select(
        JOURNEY, MODEL_LABEL, evaluate.predicted_class().alias("predicted_class")
    ),
    "bundle_scored_journeys": bundle_scored_journeys,
    "rf_risk_tiers": planted_tiers,
    "variable_importance": planted_importance,
    "rf_real_metrics": forest_metrics,
    "rf_real_scores": lambda spark, folder: forest_scored_test(spark, folder).select(JOURNEY, MODEL_LABEL, evaluate.SCORE),
    "rf_real_risk_tiers": forest_tiers,
    "sink_csv_roundtrip": sink_csv_roundtrip,
}


# What a forest learns from the real label no SQL can know; tests compute these again from the scores.
WITHOUT_SQL = ("rf_real_metrics", "rf_real_scores", "rf_real_risk_tiers")


def queries() -> dict[str, Query]:
    def with_rounding(query: Query) -> Query:
        return lambda spark, folder: rounded(query(spark, folder))

    return {name: with_rounding(query) for name, query in REGISTRY.items()}
