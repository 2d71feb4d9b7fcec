"""The plans are the ones wanted: pushed filters, pruned columns, no single-task windows on rows."""

import contextlib
import io
import os
import re

import pytest

from lapsekit.plans import queries as registered

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def _plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_eligibility_and_columns_reach_the_scan(spark):
    plan = _plan(registered.REGISTRY["gap_by_type"](spark, FOLDER))
    pushed = re.findall(r"PushedFilters: \[(.*)\]", plan)
    assert pushed and all("GreaterThanOrEqual(ObservationDays,365)" in p for p in pushed)
    columns = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<(.*)>", plan))))
    assert columns == {"FirstEncounterType", "PatientDurableKey", "MaxGapDays", "LongGap180", "ObservationDays"}


def test_build_joins_departments_after_the_aggregation(spark):
    plan = _plan(registered.REGISTRY["build_journeys"](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # From top to bottom: department join, then the aggregate over encounters.
    assert plan.index("p_partkey") > 0
    tree = plan.split("\n\n")[0]
    assert tree.count("ObjectHashAggregate") == 2
    assert "Window" not in tree


@pytest.mark.parametrize("name", ["train_test_split", "sample_cap", "outreach_list", "risk_tiers", "confusion_matrix"])
def test_no_window_over_journey_rows(spark, name):
    assert "Window" not in _plan(registered.REGISTRY[name](spark, FOLDER)).split("\n\n")[0]


def test_no_python_in_any_plan(spark):
    for name, query in registered.REGISTRY.items():
        plan = _plan(query(spark, FOLDER))
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan, name
