import pytest
from frames import journeys

from lapsekit.operators import reports
from lapsekit.settings import PORTAL_GROUPS_LONG, PORTAL_ORDER_LONG
from lapsekit.sources.tables import sql_report

ROWS = [
    (1, "clinic", "Activated", 0, 100),
    (1, "clinic", "Pending Activation", 0, 200),
    (2, "clinic", "Patient Declined", 1, 400),
    (3, None, "Unknown", None, 500),
    (3, None, None, 1, None),
    (4, "er ", "Inactivated", 1, 10),
    (5, "er", "Activated", 0, 300),
]


def test_summary_leaves_nulls_out_of_rates_but_not_of_counts(spark):
    row = reports.cohort_summary(journeys(spark, ROWS)).first()
    assert row["diabetes_journeys_observed365"] == 7
    assert row["diabetes_patients_observed365"] == 5
    assert row["long_gap_180_rate"] == pytest.approx(4 / 6)
    assert row["median_max_gap_days"] == 250.0
    assert row["any_social_risk_rate"] == pytest.approx(3 / 6)


@pytest.mark.parametrize("partitions", [1, 5])
def test_report_keeps_null_group_and_applies_support(spark, partitions):
    df = journeys(spark, ROWS).repartition(partitions)
    got = reports.gap_report(df, "FirstEncounterType", min_support=2).collect()
    assert [r["FirstEncounterType"] for r in got] == [None, "clinic"]
    assert [(r["journeys"], r["patients"], r["median_max_gap_days"]) for r in got] == [(2, 1, 500.0), (3, 2, 200.0)]
    assert [r["long_gap_180_rate"] for r in got] == [1.0, pytest.approx(2 / 3)]


def test_types_that_differ_by_blanks_stay_apart_and_share_a_place(spark):
    got = reports.encounter_type_report(journeys(spark, ROWS), min_support=1).collect()
    named = [(r["FirstEncounterType"], r["journeys"], r["label"], r["display_order"]) for r in got]
    assert sorted(named, key=str) == sorted(
        [(None, 2, "100%", None), ("er", 1, "100%", 1), ("er", 1, "0%", 1), ("clinic", 3, "66.7%", 2)], key=str
    )


def test_portal_groups_leave_other_statuses_out(spark):
    got = reports.portal_report(journeys(spark, ROWS)).collect()
    assert [(r["MyChartGroup"], r["journeys"]) for r in got] == [("Activated", 4), ("Patient declined", 1)]
    long = reports.portal_report(journeys(spark, ROWS), PORTAL_GROUPS_LONG, PORTAL_ORDER_LONG).collect()
    assert [r["MyChartGroup"] for r in long] == ["Patient declined", "Activated, pending, or inactivated"]


def test_social_risk_report_and_difference(spark):
    got = reports.social_risk_report(journeys(spark, ROWS)).collect()
    assert [(r["AnySocialRisk"], r["SocialRiskGroup"], r["journeys"]) for r in got] == [
        (0, "No social risk", 3), (1, "Any social risk", 3), (None, None, 1),
    ]
    difference = reports.social_risk_difference(journeys(spark, ROWS)).first()
    assert difference["rate_difference"] == pytest.approx(1 / 2 - 2 / 3)
    assert difference["label"] == "-16.7%"


def test_gap_stats_texts(spark):
    row = reports.gap_stats(journeys(spark, ROWS)).first()
    assert row["median_text"] == "Median max gap: 250 days"
    assert row["rate_text"] == "66.7% of observed journeys had at least one gap over 180 days"
    assert reports.gap_stats_capped(journeys(spark, ROWS)).first()["mean_gap"] == pytest.approx(1510 / 6)


def test_sql_text_over_the_table(spark):
    got = sql_report(
        journeys(spark, ROWS),
        "SELECT MyChartStatus AS s, COUNT(*) AS n FROM {journeys} GROUP BY s HAVING s IS NOT NULL ORDER BY n DESC LIMIT 1",
    ).first()
    assert (got["s"], got["n"]) == ("Activated", 2)


def test_sketches_come_near_the_exact_reports(spark):
    rows = [(i // 2, "ab"[i % 2], "Activated", i % 2, i % 500) for i in range(4_000)]
    df = journeys(spark, rows)
    exact, near = (reports.cohort_summary(df, approximate=a).first() for a in (False, True))
    assert near.asDict().keys() == exact.asDict().keys()
    for name, value in exact.asDict().items():
        assert near[name] == pytest.approx(value, rel=0.1)
    exact, near = (
        {r["FirstEncounterType"]: r for r in reports.gap_report(df, "FirstEncounterType", approximate=a).collect()}
        for a in (False, True)
    )
    for key, row in exact.items():
        assert near[key]["journeys"] == row["journeys"] == 2_000
        assert near[key]["patients"] == pytest.approx(row["patients"], rel=0.1)
        assert near[key]["median_max_gap_days"] == pytest.approx(row["median_max_gap_days"], rel=0.02)
