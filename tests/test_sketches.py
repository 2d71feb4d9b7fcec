"""Daily sketches against the exact reports."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lapsekit.operators.reports import gap_report
from lapsekit.operators.sketches import PATIENT_ERROR, RANK_ERROR, daily_sketches, merged, sketched_report

SCHEMA = "JourneyKey string, PatientDurableKey bigint, FirstDate date, FirstEncounterType string, LongGap180 int, MaxGapDays int"


@pytest.fixture(scope="module")
def journeys(spark):
    rng = random.Random(4)
    rows = []
    for i in range(30_000):
        kind = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        gap = None if rng.random() < 0.1 else int(rng.lognormvariate(4, 1))
        day = None if i % 500 == 0 else date(2020, 1, 1) + timedelta(days=rng.randrange(60))
        rows.append((f"j{i}", rng.randrange(9_000), day, kind, None if gap is None else int(gap > 180), gap))
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def ranks(journeys, kind, value):
    gaps = sorted(r["MaxGapDays"] for r in journeys.filter(F.col("FirstEncounterType").eqNullSafe(kind)).collect() if r["MaxGapDays"] is not None)
    return sum(g < value for g in gaps) / len(gaps), sum(g <= value for g in gaps) / len(gaps)


def test_report_is_within_its_errors(journeys):
    exact = {r["FirstEncounterType"]: r for r in gap_report(journeys, "FirstEncounterType").collect()}
    got = {r["FirstEncounterType"]: r for r in sketched_report(daily_sketches(journeys, "FirstEncounterType"), "FirstEncounterType").collect()}
    assert got.keys() == exact.keys() == {"hot", "a", "b", None}
    for kind, r in got.items():
        assert r["journeys"] == exact[kind]["journeys"]
        assert r["long_gap_180_rate"] == pytest.approx(exact[kind]["long_gap_180_rate"], abs=1e-12)
        assert abs(r["patients"] / exact[kind]["patients"] - 1) <= PATIENT_ERROR
        below, upto = ranks(journeys, kind, r["median_max_gap_days"])
        assert below <= 0.5 + RANK_ERROR and upto >= 0.5 - RANK_ERROR


def test_days_added_later_merge_to_the_same_as_all_at_once(journeys):
    cut = F.col("FirstDate") < "2020-02-01"
    whole = daily_sketches(journeys, "FirstEncounterType")
    parts = daily_sketches(journeys.filter(cut), "FirstEncounterType").unionByName(
        daily_sketches(journeys.filter(~cut | cut.isNull()), "FirstEncounterType")
    )
    values = lambda df: {
        r["level"]: tuple(r)[1:] for r in merged(df, "level").select("level", "journeys", "known", "gaps", F.hll_sketch_estimate("patients")).collect()
    }
    got, expected = values(parts), values(whole)
    assert got.keys() == expected.keys()
    for level, row in got.items():
        assert row[:3] == expected[level][:3]
        # The estimate of a union depends a little on what was united when.
        assert row[3] == pytest.approx(expected[level][3], rel=PATIENT_ERROR / 2)
    assert parts.count() == whole.count()


def test_a_span_of_days_reads_only_its_rows(spark, journeys, tmp_path):
    daily_sketches(journeys, "FirstEncounterType").write.parquet(str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))
    first, last = date(2020, 1, 10), date(2020, 1, 20)
    report = sketched_report(stored, "FirstEncounterType", first=first, last=last, min_support=1)
    inside = journeys.filter(F.col("FirstDate").between(first, last))
    exact = {r["FirstEncounterType"]: r["journeys"] for r in gap_report(inside, "FirstEncounterType", min_support=1).collect()}
    assert {r["FirstEncounterType"]: r["journeys"] for r in report.collect()} == exact
    assert "PushedFilters: [IsNotNull(day), GreaterThanOrEqual(day" in report._jdf.queryExecution().toString()


def test_levels_without_gaps_and_empty_tables(spark, journeys):
    none = journeys.limit(3).withColumn("MaxGapDays", F.lit(None).cast("int")).withColumn("LongGap180", F.lit(None).cast("int"))
    got = sketched_report(daily_sketches(none, "FirstEncounterType"), "FirstEncounterType", min_support=1).collect()
    assert {(r["long_gap_180_rate"], r["median_max_gap_days"]) for r in got} == {(None, None)}
    assert sketched_report(daily_sketches(journeys.limit(0), "FirstEncounterType"), "FirstEncounterType").collect() == []
