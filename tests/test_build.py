import os
import random
from datetime import date, timedelta

import pytest
from frames import encounters
from pyspark.sql import functions as F

from lapsekit.operators.build import screening_profile, visit_gaps, with_screening
from lapsekit.operators.cohort import charted_gaps, eligible, gap_groups, observed
from lapsekit.plans.store import stored_journeys


def _by_key(df):
    return {r["JourneyKey"]: r for r in df.collect()}


def test_gaps_between_distinct_visit_days(spark):
    visits = [
        (1, "F", "2020-01-01"),  # one visit only: no gap
        (2, "F", "2020-02-28"), (2, "F", "2020-03-01"),  # over a leap day: 2 days
        (3, "F", "2021-01-01"), (3, "F", "2021-01-01"), (3, "F", "2021-06-30"),  # repeated day; 180
        (4, "F", "2021-01-01"), (4, "F", "2021-07-01"), (4, "O", "2021-07-02"),  # 181; other journey
        (5, "F", None), (5, "F", "2021-01-05"),  # a visit without a date does not count
    ]
    got = _by_key(visit_gaps(encounters(spark, visits)))
    assert {k: r["MaxGapDays"] for k, r in got.items()} == {
        "1-F": None, "2-F": 2, "3-F": 180, "4-F": 181, "4-O": None, "5-F": None,
    }
    assert {k: r["LongGap180"] for k, r in got.items()} == {
        "1-F": None, "2-F": 0, "3-F": 0, "4-F": 1, "4-O": None, "5-F": None,
    }
    assert (got["3-F"]["NumEncounters"], got["3-F"]["NumVisitDays"]) == (3, 2)
    assert got["5-F"]["NumEncounters"] == 1
    assert got["4-F"]["FirstDate"] == date(2021, 1, 1)


def test_open_gap_to_the_observation_end(spark):
    visits = [(1, "F", "2020-01-01"), (2, "F", "2020-01-01"), (2, "F", "2020-12-01")]
    got = _by_key(visit_gaps(encounters(spark, visits), open_gap_until=date(2021, 1, 1)))
    assert (got["1-F"]["MaxGapDays"], got["2-F"]["MaxGapDays"]) == (366, 335)


def test_first_encounter_by_day_then_key_then_line(spark):
    visits = [
        (1, "F", "2020-01-02", 1, 1),
        (1, "F", "2020-01-01", 9, 2),
        (1, "F", "2020-01-01", 9, 1),
        (1, "F", "2020-01-01", 10, 0),
    ]
    for partitions in (1, 4):
        got = visit_gaps(encounters(spark, visits).repartition(partitions)).first()
        assert got["FirstEncounterType"] == "type-9-1"


def test_many_encounters_of_one_journey(spark):
    df = spark.range(30_000).selectExpr(
        "1L AS PatientDurableKey", "'F' AS JourneyPart", "date_add(DATE'2020-01-01', CAST(id % 400 AS INT) * 2) AS VisitDate",
        "id AS EncounterKey", "1 AS EncounterLine", "7L AS DepartmentKey", "'A' AS DepartmentType",
        "'t' AS EncounterType", "'F' AS SmokingStatus",
    )
    row = visit_gaps(df.repartition(6)).first()
    assert (row["NumEncounters"], row["NumVisitDays"], row["MaxGapDays"]) == (30_000, 400, 2)


def test_screening_flags_and_zeros(spark):
    answers = spark.createDataFrame(
        [(1, "view", 0), (1, "view", None), (1, "click", 7), (2, "view", None)],
        "PatientDurableKey bigint, Domain string, RiskSlot int",
    )
    assert screening_profile(answers).count() == 2
    people = spark.createDataFrame([(1,), (2,), (3,)], "PatientDurableKey bigint")
    got = {r["PatientDurableKey"]: r for r in with_screening(people, answers).collect()}
    assert (got[1]["SdohDomainsAnswered"], got[1]["SocialRiskCount"], got[1]["AnySocialRisk"]) == (2, 2, 1)
    assert (got[1]["TransportationRisk"], got[1]["FoodRisk"], got[1]["UtilitiesRisk"]) == (1, 0, 1)
    assert (got[2]["HasSdohScreening"], got[2]["AnySocialRisk"]) == (1, 0)
    assert (got[3]["HasSdohScreening"], got[3]["SdohDomainsAnswered"], got[3]["AnySocialRisk"]) == (0, 0, 0)


def test_observation_days_and_eligibility(spark):
    df = spark.createDataFrame(
        [("a", date(2024, 12, 31)), ("b", date(2025, 1, 1)), ("c", None)], "JourneyKey string, FirstDate date"
    )
    days = {r["JourneyKey"]: r["ObservationDays"] for r in observed(df).collect()}
    assert days == {"a": 365, "b": 364}
    assert [r["JourneyKey"] for r in eligible(observed(df)).collect()] == ["a"]


def test_charted_gaps_are_bounded_on_both_sides(spark):
    df = spark.createDataFrame([(0,), (180,), (181,), (1460,), (1461,), (None,)], "MaxGapDays int")
    assert charted_gaps(df).count() == 4
    groups = sorted((r["MaxGapDays"], r["GapGroup"]) for r in gap_groups(df).collect())
    assert groups == [
        (0, "Gap 180 days or less"), (180, "Gap 180 days or less"),
        (181, "Gap over 180 days"), (1460, "Gap over 180 days"),
    ]


def test_random_visits_against_brute_force(spark):
    rng = random.Random(11)
    # Journey 1-F holds a third of all visits.
    visits = []
    for i in range(600):
        patient, part = (1, "F") if i % 3 == 0 else (rng.randrange(1, 30), rng.choice("FO"))
        day = date(2019, 1, 1) + timedelta(days=rng.randrange(2_000))
        visits.append((patient, part, day.isoformat(), rng.randrange(50), i))
    expected = {}
    for patient, part, day, key, line in visits:
        expected.setdefault(f"{patient}-{part}", []).append((date.fromisoformat(day), key, line))
    for partitions in (1, 5):
        got = _by_key(visit_gaps(encounters(spark, visits).repartition(partitions)))
        assert got.keys() == expected.keys()
        for name, rows in expected.items():
            days = sorted({d for d, *_ in rows})
            gaps = [(b - a).days for a, b in zip(days, days[1:])]
            first = min(rows)
            r = got[name]
            assert (r["NumEncounters"], r["NumVisitDays"], r["FirstDate"]) == (len(rows), len(days), days[0])
            assert r["MaxGapDays"] == max(gaps, default=None)
            assert r["FirstEncounterType"] == f"type-{first[1]}-{first[2]}"


@pytest.mark.skipif(not os.path.isdir("/root/testdata"), reason="no test tables")
@pytest.mark.parametrize(
    "scale, journeys, patients, without_gap, kept, kept_patients, complete",
    [
        ("sf0.001", 300, 150, 0, 216, 141, 174),
        ("sf0.01", 2_998, 1_500, 3, 2_220, 1_373, 1_772),
        ("sf0.1", 29_992, 14_999, 10, 22_286, 13_832, 17_781),
    ],
)
def test_known_counts(spark, scale, journeys, patients, without_gap, kept, kept_patients, complete):
    table = stored_journeys(spark, f"/root/testdata/{scale}")
    counts = (
        F.count("*"), F.count_distinct("PatientDurableKey"), F.count(F.when(F.col("MaxGapDays").isNull(), 1)),
    )
    assert tuple(table.agg(*counts).first()) == (journeys, patients, without_gap)
    rows = eligible(table)
    assert tuple(rows.agg(*counts[:2]).first()) == (kept, kept_patients)
    assert rows.na.drop("any", subset=["LongGap365", "MyChartStatus"]).count() == complete
