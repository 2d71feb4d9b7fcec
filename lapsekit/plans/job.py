"""The whole analysis as one batch job.

    spark-submit journey_job.py --input TABLES --output FOLDER
    spark-submit journey_job.py --input TABLES --output FOLDER --score-with MODEL

From an observed-journey table it writes the report tables as CSV, the scored
test journeys, the scores of all eligible journeys and the outreach list among
them as Parquet, and the model: forest, kept levels, tier cuts. The second form
scores the eligible journeys of other tables with such a model.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from lapsekit.operators import evaluate, forest, ranking
from lapsekit.operators.build import build_journeys
from lapsekit.operators.cohort import eligible, gap_groups, gap_values, observed
from lapsekit.operators.frame import complete_rows, model_columns, varying_features
from lapsekit.operators.histogram import histogram
from lapsekit.operators.lumping import Lumping, fit_lumping
from lapsekit.operators.reports import (
    cohort_summary,
    encounter_type_report,
    gap_report,
    gap_stats,
    gap_stats_capped,
    portal_report,
    social_risk_difference,
    social_risk_report,
)
from lapsekit.operators.sampling import sample_cap, with_split
from lapsekit.plans.bundle import Bundle, load_bundle, save_bundle, score_journeys
from lapsekit.session import discard_staged, stage
from lapsekit.settings import (
    GROUPED_HISTOGRAM_BINS,
    HISTOGRAM_BINS,
    LABEL,
    MIN_OBSERVATION_DAYS,
    MIN_SUPPORT,
    OBSERVATION_END,
    PORTAL_GROUPS_LONG,
    PORTAL_ORDER_LONG,
    SEED,
    SOCIAL_RISK_NAMES_RECORDED,
    TRAIN_FRACTION,
    rate_name,
)
from lapsekit.sources.csv_reports import write_report
from lapsekit.sources.star_schema import STAR_OBSERVATION_END, journey_inputs
from lapsekit.sources.tables import write_table

# Names of the report tables.
METRICS = "28_clean_rf_metrics_no_year_observed365"
CONFUSION = "29_clean_rf_confusion_matrix_no_year_observed365"
IMPORTANCE = "30_clean_rf_variable_importance_no_year_observed365"
TIERS = "31_clean_risk_group_performance_no_year_observed365"
SUMMARY = "32_observed365_main_summary"
BY_TYPE = "33_observed365_gap_by_first_encounter_type"
BY_SPECIALTY = "34_observed365_gap_by_department_specialty"
BY_PORTAL = "40_observed365_gap_by_mychart_combined"
BY_SOCIAL_RISK = "40_social_risk_line_clean_style"


@dataclass(frozen=True)
class JobSettings:
    label: str = LABEL
    min_observation_days: int = MIN_OBSERVATION_DAYS
    min_support: int = MIN_SUPPORT
    seed: int = SEED
    train_fraction: float = TRAIN_FRACTION
    # Training rows the forest is fitted on; None means all. Nothing else is cut.
    sample_rows: int | None = None
    # Keep all journeys with the same value of this column on one side of the split.
    split_by: str | None = None
    # Learn the kept levels from all rows, or from the training rows alone.
    lump_on_train_only: bool = False
    trees: forest.ForestSettings = field(default_factory=forest.ForestSettings)


def write_reports(journeys: DataFrame, output: str, settings: JobSettings = JobSettings()) -> None:
    """The descriptive reports of eligible journeys and the tables behind the charts."""
    label, support = settings.label, settings.min_support
    rate = rate_name(label)
    reports = {
        SUMMARY: cohort_summary(journeys),
        BY_TYPE: gap_report(journeys, "FirstEncounterType", min_support=support, label=label),
        BY_SPECIALTY: gap_report(journeys, "FirstDepartmentSpecialty", min_support=support, label=label),
        BY_PORTAL: portal_report(journeys, label=label).select("MyChartGroup", "journeys", rate),
        BY_SOCIAL_RISK: social_risk_report(journeys, label=label).select(
            "AnySocialRisk", "journeys", rate, "SocialRiskGroup"
        ),
        "chart_gap_histogram": histogram(gap_values(journeys), "MaxGapDays", HISTOGRAM_BINS),
        "chart_gap_histogram_grouped": histogram(
            gap_groups(journeys), "MaxGapDays", GROUPED_HISTOGRAM_BINS, by=["GapGroup"]
        ),
        "chart_gap_stats": gap_stats(journeys, label=label),
        "chart_gap_stats_capped": gap_stats_capped(journeys),
        "chart_encounter_types": encounter_type_report(journeys, min_support=support, label=label),
        "chart_portal": portal_report(journeys, PORTAL_GROUPS_LONG, PORTAL_ORDER_LONG, label=label),
        "chart_social_risk": social_risk_report(journeys, SOCIAL_RISK_NAMES_RECORDED, label=label),
        "chart_social_risk_difference": social_risk_difference(journeys, label=label),
    }
    for name, report in reports.items():
        write_report(report, f"{output}/{name}")


def prepare_rows(journeys: DataFrame, settings: JobSettings = JobSettings()) -> tuple[DataFrame, Lumping]:
    """All model rows with their split, lumped once for the many passes of training, and their lumping."""
    label = settings.label
    columns = model_columns(journeys, label)
    split = {"fraction": settings.train_fraction, "seed": settings.seed, "group_col": settings.split_by}
    if settings.lump_on_train_only:
        rows = with_split(complete_rows(columns, label), **split)
        lumping = fit_lumping(rows.filter("split = 'train'"))
        return stage(lumping.apply(rows), "model-rows"), lumping
    lumping = fit_lumping(columns)
    frame = stage(complete_rows(lumping.apply(columns), label), "model-frame")
    return with_split(frame, **split), lumping


def training_rows(rows: DataFrame, settings: JobSettings = JobSettings()) -> DataFrame:
    """The rows the forest is fitted on; only these are bounded by ``sample_rows``."""
    return sample_cap(rows.filter("split = 'train'"), settings.sample_rows, seed=settings.seed)


def write_scores(bundle: Bundle, journeys: DataFrame, output: str) -> None:
    """Scores and tiers of all eligible journeys, and the outreach list among them."""
    scored = write_table(score_journeys(bundle, journeys), f"{output}/scored_all_journeys")
    evaluate.outreach_list(scored).write.mode("overwrite").partitionBy("risk_group").parquet(f"{output}/outreach")


def write_model(journeys: DataFrame, output: str, settings: JobSettings = JobSettings()) -> None:
    """Train, score the test rows, write what is known about the model, then score every eligible journey.

    The tiers are cut at the test rows' scores. Training rows are scored by
    trees that have seen them; the reports are on test rows alone.
    """
    label = settings.label
    rows, lumping = prepare_rows(journeys, settings)
    train, test = training_rows(rows, settings), rows.filter("split = 'test'")
    features = varying_features(rows, label)
    fitted = forest.train_forest(train, features, label=label, settings=settings.trees)

    scored = stage(forest.score(fitted, forest.dealt_evenly(test)), "scored")
    bundle = Bundle(fitted, lumping, evaluate.tier_cuts(scored))
    save_bundle(bundle, f"{output}/model", rows.sparkSession)
    tiered = write_table(evaluate.with_risk_tier(scored, cuts=bundle.cuts), f"{output}/scored_journeys")
    importance = stage(
        forest.permutation_importance(fitted, test, seed=settings.seed), "importance"
    )
    reports = {
        METRICS: evaluate.metrics(
            scored, train, label, observation_filter=f"ObservationDays >= {settings.min_observation_days}"
        ),
        CONFUSION: evaluate.confusion_matrix(scored, label),
        IMPORTANCE: ranking.by_importance(importance),
        TIERS: evaluate.risk_tier_report(tiered, label).drop("label"),
        "chart_top_importance": ranking.top_importance(importance),
        "chart_top_predictors": ranking.top_predictors(importance),
        "chart_risk_tiers": evaluate.risk_tier_report(tiered, label),
        "split_gain_importance": forest.gini_importance(fitted, rows.sparkSession),
    }
    for name, report in reports.items():
        write_report(report, f"{output}/{name}")
    write_scores(bundle, journeys, output)


def run(
    observed_journeys: DataFrame, output: str, settings: JobSettings = JobSettings(), score_with: str | None = None
) -> None:
    """Everything from a stored observed-journey table, or only scores by the model stored at ``score_with``."""
    journeys = eligible(observed_journeys, settings.min_observation_days)
    if score_with:
        write_scores(load_bundle(journeys.sparkSession, score_with), journeys, output)
        return
    write_reports(journeys, output, settings)
    write_model(journeys, output, settings)


def run_on_star_schema(
    spark: SparkSession,
    input_folder: str,
    output: str,
    settings: JobSettings = JobSettings(),
    observation_end: date = STAR_OBSERVATION_END,
    score_with: str | None = None,
) -> None:
    """Build and store the journey table first, then everything."""
    built = observed(build_journeys(journey_inputs(spark, input_folder)), observation_end)
    run(write_table(built, f"{output}/journeys_observed"), output, settings, score_with)


def run_on_journeys(
    spark: SparkSession,
    journeys_path: str,
    output: str,
    settings: JobSettings = JobSettings(),
    observation_end: date = OBSERVATION_END,
    score_with: str | None = None,
) -> None:
    """Everything, from a stored journey table without observation days."""
    table = observed(spark.read.parquet(journeys_path), observation_end)
    run(write_table(table, f"{output}/journeys_observed"), output, settings, score_with)


def main() -> None:
    parser = argparse.ArgumentParser(description="Follow-up-gap analysis of patient journeys")
    parser.add_argument("--input", required=True, help="folder of star-schema tables, or a journey table")
    parser.add_argument("--output", required=True)
    parser.add_argument("--journeys", action="store_true", help="--input is a journey table")
    parser.add_argument("--observation-end", type=date.fromisoformat)
    parser.add_argument("--label", default=LABEL)
    parser.add_argument("--min-observation-days", type=int, default=MIN_OBSERVATION_DAYS)
    parser.add_argument("--min-support", type=int, default=MIN_SUPPORT)
    parser.add_argument("--seed", type=int, default=SEED)
    parser.add_argument("--train-fraction", type=float, default=TRAIN_FRACTION)
    parser.add_argument("--sample-rows", type=int, help="bound on the rows the forest is fitted on")
    parser.add_argument("--split-by", help="column whose rows stay on one side of the split")
    parser.add_argument("--lump-on-train-only", action="store_true")
    parser.add_argument("--trees", type=int, default=forest.ForestSettings.trees)
    parser.add_argument("--max-depth", type=int, default=forest.ForestSettings.max_depth)
    parser.add_argument("--min-node-size", type=int, default=forest.ForestSettings.min_node_size)
    parser.add_argument("--score-with", metavar="MODEL", help="only score, with the model folder of an earlier run")
    args = parser.parse_args()
    settings = JobSettings(
        label=args.label,
        min_observation_days=args.min_observation_days,
        min_support=args.min_support,
        seed=args.seed,
        train_fraction=args.train_fraction,
        sample_rows=args.sample_rows,
        split_by=args.split_by,
        lump_on_train_only=args.lump_on_train_only,
        trees=forest.ForestSettings(
            trees=args.trees, max_depth=args.max_depth, min_node_size=args.min_node_size, seed=args.seed
        ),
    )
    spark = SparkSession.builder.appName("lapsekit").getOrCreate()
    start, end = (
        (run_on_journeys, OBSERVATION_END) if args.journeys else (run_on_star_schema, STAR_OBSERVATION_END)
    )
    try:
        start(spark, args.input, args.output, settings, args.observation_end or end, args.score_with)
    finally:
        discard_staged(spark)
        spark.stop()


if __name__ == "__main__":
    main()
