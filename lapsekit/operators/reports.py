"""Aggregate reports over eligible journeys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsekit.functions.labels import (
    change_label,
    group_of,
    level_position,
    named_codes,
    percent_label,
    trimmed,
    truncated,
    whole_days,
)
from lapsekit.operators.cohort import charted_gaps
from lapsekit.settings import (
    GAP_THRESHOLDS,
    LABEL,
    MIN_SUPPORT,
    PATIENT,
    PORTAL_GROUPS_SHORT,
    PORTAL_ORDER_SHORT,
    SOCIAL_RISK_NAMES,
    rate_name,
)


def _median(name: str, approximate: bool) -> Column:
    if approximate:
        return F.percentile_approx(name, 0.5, 10_000).cast("double")
    return F.median(name)


def cohort_summary(journeys: DataFrame, *, approximate: bool = False) -> DataFrame:
    """One row of whole-cohort measures.

    The exact patient count is its own aggregate: put in one with the medians,
    Spark would carry a median buffer per patient through the shuffle. The
    buffers here hold one entry per distinct day count or visit count. Both
    parts scan ``journeys``, so give it a stored table.

    ``approximate`` takes sketches in place of the exact patient count and
    medians: one scan, and no shuffle but of one row per task.
    """
    measures = [
        F.count("*").alias("diabetes_journeys_observed365"),
        *(F.avg(f"LongGap{days}").alias(f"long_gap_{days}_rate") for days in GAP_THRESHOLDS),
        _median("MaxGapDays", approximate).alias("median_max_gap_days"),
        F.avg("MaxGapDays").alias("mean_max_gap_days"),
        _median("NumEncounters", approximate).alias("median_encounters"),
        _median("NumVisitDays", approximate).alias("median_visit_days"),
        F.avg("HasSdohScreening").alias("sdoh_screened_rate"),
        F.avg("AnySocialRisk").alias("any_social_risk_rate"),
        F.avg("SocialRiskCount").alias("mean_social_risk_count"),
    ]
    patients = "diabetes_patients_observed365"
    if approximate:
        summary = journeys.agg(*measures, F.approx_count_distinct(PATIENT).alias(patients))
    else:
        exact = journeys.agg(F.count_distinct(PATIENT).alias(patients))
        summary = journeys.agg(*measures).crossJoin(exact)
    first, *rest = (name for name in summary.columns if name != patients)
    return summary.select(first, patients, *rest)


def gap_report(
    journeys: DataFrame,
    key: str,
    *,
    min_support: int = MIN_SUPPORT,
    label: str = LABEL,
    approximate: bool = False,
) -> DataFrame:
    """Journeys, patients, gap rate and median gap per value of ``key``.

    As in :func:`cohort_summary` the patients are counted apart from the other
    measures. That count shuffles (key, patient) pairs, so a value of ``key``
    that holds most journeys is spread over its patients; the measures send one
    row per value and task. What is joined is the size of the report.
    ``approximate`` works as it does there.
    """
    rate = rate_name(label)
    measures = [
        F.count("*").alias("journeys"),
        F.avg(label).alias(rate),
        _median("MaxGapDays", approximate).alias("median_max_gap_days"),
    ]
    supported = F.col("journeys") >= min_support
    if approximate:
        patients = F.approx_count_distinct(PATIENT).alias("patients")
        report = journeys.groupBy(key).agg(*measures, patients).filter(supported)
    else:
        pairs = journeys.groupBy(F.col(key).alias("_key"))
        patients = pairs.agg(F.count_distinct(PATIENT).alias("patients"))
        report = journeys.groupBy(key).agg(*measures).filter(supported)
        report = report.join(patients, F.col(key).eqNullSafe(F.col("_key")))
    return report.select(key, "journeys", "patients", rate, "median_max_gap_days").orderBy(
        F.desc_nulls_last(rate), F.asc_nulls_last(key)
    )


def short_report(journeys: DataFrame, key: str | Column, *, label: str = LABEL) -> DataFrame:
    """Journeys and gap rate per value of ``key``; null is a value too."""
    return journeys.groupBy(key).agg(
        F.count("*").alias("journeys"),
        F.avg(label).alias(rate_name(label)),
    )


def with_display_order(report: DataFrame, name: str, value: str) -> DataFrame:
    """Chart position of each name: by the median value of the rows that bear it.

    The windows run over report rows, one per category.
    """
    named = F.col(name).isNotNull()
    middle = F.when(named, F.median(value).over(Window.partitionBy(name)))
    place = F.dense_rank().over(Window.orderBy(F.asc_nulls_last("_middle"), F.asc_nulls_last(name)))
    return (
        report.withColumn("_middle", middle)
        .withColumn("display_order", F.when(named, place))
        .drop("_middle")
    )


def encounter_type_report(
    journeys: DataFrame, *, key: str = "FirstEncounterType", min_support: int = MIN_SUPPORT, label: str = LABEL
) -> DataFrame:
    """Gap rate per encounter type as charted: trimmed name, label, position.

    Names are trimmed after grouping, so types that differ by blanks stay apart.
    """
    rate = rate_name(label)
    report = short_report(journeys, key, label=label).filter(F.col("journeys") >= min_support)
    named = report.select(
        trimmed(F.col(key)).alias(key),
        truncated(F.col(key)).alias("short_name"),
        "journeys",
        rate,
        percent_label(F.col(rate)).alias("label"),
    )
    return with_display_order(named, key, rate).orderBy(F.desc_nulls_last(rate), F.asc_nulls_last(key))


def portal_report(
    journeys: DataFrame,
    groups: Mapping[str, str] = PORTAL_GROUPS_SHORT,
    order: tuple[str, ...] = PORTAL_ORDER_SHORT,
    *,
    label: str = LABEL,
) -> DataFrame:
    """Gap rate per portal-status group; statuses outside all groups are left out."""
    rate = rate_name(label)
    grouped = journeys.withColumn("MyChartGroup", group_of(F.col("MyChartStatus"), groups))
    report = short_report(grouped, "MyChartGroup", label=label).filter(F.col("MyChartGroup").isNotNull())
    return (
        report.withColumn("label", percent_label(F.col(rate)))
        .withColumn("display_order", level_position(F.col("MyChartGroup"), order))
        .orderBy("display_order")
    )


def social_risk_report(
    journeys: DataFrame, names: Mapping[int, str] = SOCIAL_RISK_NAMES, *, label: str = LABEL
) -> DataFrame:
    """Gap rate without and with recorded social risk; unknown risk comes last."""
    rate = rate_name(label)
    return (
        short_report(journeys, "AnySocialRisk", label=label)
        .withColumn("SocialRiskGroup", named_codes(F.col("AnySocialRisk"), names))
        .withColumn("label", percent_label(F.col(rate)))
        .orderBy(F.asc_nulls_last("AnySocialRisk"))
    )


def social_risk_difference(journeys: DataFrame, *, label: str = LABEL) -> DataFrame:
    """Gap rate with any social risk less the rate without, and its label."""
    with_risk = F.avg(F.when(F.col("AnySocialRisk") == 1, F.col(label)))
    without = F.avg(F.when(F.col("AnySocialRisk") == 0, F.col(label)))
    return journeys.agg((with_risk - without).alias("rate_difference")).withColumn(
        "label", change_label(F.col("rate_difference"))
    )


def gap_stats(journeys: DataFrame, *, label: str = LABEL) -> DataFrame:
    """Median gap and gap rate of all journeys with a known gap, with chart texts."""
    rate = rate_name(label)
    stats = journeys.filter(F.col("MaxGapDays").isNotNull()).agg(
        F.median("MaxGapDays").alias("median_gap"), F.avg(label).alias(rate)
    )
    return stats.withColumns(
        {
            "median_text": F.concat(F.lit("Median max gap: "), whole_days(F.col("median_gap")), F.lit(" days")),
            "rate_text": F.concat(
                percent_label(F.col(rate)),
                F.lit(f" of observed journeys had at least one gap over {label.removeprefix('LongGap')} days"),
            ),
        }
    )


def gap_stats_capped(journeys: DataFrame) -> DataFrame:
    """Median and mean gap within the charted range, with the chart text."""
    stats = charted_gaps(journeys).agg(
        F.median("MaxGapDays").alias("median_gap"), F.avg("MaxGapDays").alias("mean_gap")
    )
    text = F.concat(F.lit("Median: "), whole_days(F.col("median_gap")), F.lit(" days"))
    return stats.withColumn("median_text", text)
