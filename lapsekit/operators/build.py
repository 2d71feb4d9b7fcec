"""Encounter rows to one row per journey."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from lapsekit.settings import GAP_THRESHOLDS, JOURNEY, PATIENT, RISK_DOMAINS


def visit_gaps(
    encounters: DataFrame,
    *,
    thresholds: Sequence[int] = GAP_THRESHOLDS,
    open_gap_until: date | None = None,
) -> DataFrame:
    """Per journey: visit counts, longest gap, gap flags, first-visit attributes.

    One aggregation does all of it. Each map task sends at most one row per
    journey, holding the set of its visit days (at most one entry per calendar
    day, however many encounters there are) and its earliest encounter. So a
    journey that holds a large share of all encounters costs its reducer no
    more than any other, and the gaps follow from the sorted days in place of
    a window over encounter rows.

    ``open_gap_until`` also counts the days from the last visit to that date.
    """
    first = F.min(
        F.struct("VisitDate", "EncounterKey", "EncounterLine", "DepartmentKey",
                 "DepartmentType", "EncounterType", "SmokingStatus")
    )
    visits = (
        encounters.filter(F.col("VisitDate").isNotNull())
        .groupBy(PATIENT, "JourneyPart")
        .agg(
            F.count("*").alias("NumEncounters"),
            F.sort_array(F.collect_set("VisitDate")).alias("days"),
            first.alias("first"),
        )
    )
    return visits.select(
        F.concat_ws("-", F.col(PATIENT).cast("string"), "JourneyPart").alias(JOURNEY),
        PATIENT,
        F.col("first.VisitDate").alias("FirstDate"),
        _longest_gap(F.col("days"), open_gap_until).alias("MaxGapDays"),
        "NumEncounters",
        F.size("days").cast("long").alias("NumVisitDays"),
        F.col("first.EncounterType").alias("FirstEncounterType"),
        F.col("first.DepartmentKey").alias("DepartmentKey"),
        F.col("first.DepartmentType").alias("FirstDepartmentType"),
        F.year("first.VisitDate").alias("FirstEncounterYear"),
        F.col("first.SmokingStatus").alias("SmokingStatus"),
    ).withColumns({f"LongGap{days}": (F.col("MaxGapDays") > days).cast("int") for days in thresholds})


def _longest_gap(days: Column, open_gap_until: date | None) -> Column:
    later = F.slice(days, F.lit(2), F.size(days) - 1)
    earlier = F.slice(days, F.lit(1), F.size(days) - 1)
    longest = F.array_max(F.zip_with(later, earlier, lambda a, b: F.date_diff(a, b)))
    if open_gap_until is None:
        return longest
    return F.greatest(longest, F.date_diff(F.lit(open_gap_until), F.element_at(days, -1)))


def screening_profile(answers: DataFrame) -> DataFrame:
    """One row per screened patient: domains answered and a flag per risk domain.

    The exact distinct count makes Spark aggregate by (patient, domain) first,
    so a patient with very many answers is spread before the final merge.
    """
    flags = [
        F.max((F.coalesce(F.col("RiskSlot"), F.lit(-1)) == i).cast("int")).alias(name)
        for i, name in enumerate(RISK_DOMAINS)
    ]
    return answers.groupBy(PATIENT).agg(
        F.count_distinct("Domain").cast("int").alias("SdohDomainsAnswered"), *flags
    )


def with_screening(journeys: DataFrame, answers: DataFrame) -> DataFrame:
    """Journeys with their patient's screening profile; no answers means zeros."""
    profile = screening_profile(answers).withColumn("HasSdohScreening", F.lit(1))
    counted = ["HasSdohScreening", "SdohDomainsAnswered", *RISK_DOMAINS]
    joined = journeys.join(profile, PATIENT, "left").na.fill(0, counted)
    risks = sum((F.col(name) for name in RISK_DOMAINS), F.lit(0))
    return joined.withColumn("SocialRiskCount", risks).withColumn(
        "AnySocialRisk", (F.col("SocialRiskCount") > 0).cast("int")
    )


def build_journeys(inputs, *, thresholds=GAP_THRESHOLDS, open_gap_until: date | None = None) -> DataFrame:
    """The journey table: visit gaps joined to departments and patients.

    Departments are looked up for the first visit only, after the aggregation,
    so that join carries journeys and not encounters. No side is forced to
    broadcast: Spark does so where its own size check allows.
    """
    journeys = visit_gaps(inputs.encounters, thresholds=thresholds, open_gap_until=open_gap_until)
    with_patients = journeys.join(inputs.patients, PATIENT, "left")
    return (
        with_screening(with_patients, inputs.answers)
        .join(inputs.departments, "DepartmentKey", "left")
        .select(
            JOURNEY, PATIENT, "FirstDate", "MaxGapDays",
            *(f"LongGap{days}" for days in thresholds),
            "NumEncounters", "NumVisitDays",
            "FirstEncounterType", "FirstVisitTypeDescription",
            "FirstDepartmentType", "FirstDepartmentSpecialty", "FirstEncounterYear",
            "PatientBirthYearBin", "SexAssignedAtBirth", "OmbRace", "OmbEthnicity",
            "MyChartStatus", "SmokingStatus",
            "HasSdohScreening", "SdohDomainsAnswered", "AnySocialRisk",
            *RISK_DOMAINS, "SocialRiskCount",
        )
    )
