import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lapsekit.operators.forest import ForestSettings
from lapsekit.operators.frame import varying_features
from lapsekit.operators.cohort import eligible
from lapsekit.plans import job
from lapsekit.plans.bundle import load_bundle, score_journeys
from lapsekit.settings import FEATURES
from lapsekit.sources.csv_reports import read_report

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SETTINGS = job.JobSettings(label="LongGap365", min_support=1, trees=ForestSettings(trees=5, max_depth=4))


@pytest.fixture(scope="module")
def output(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("job"))
    job.run_on_star_schema(spark, FOLDER, folder, SETTINGS)
    return folder


def test_all_report_tables_are_written(output):
    expected = {
        job.METRICS, job.CONFUSION, job.IMPORTANCE, job.TIERS, job.SUMMARY,
        job.BY_TYPE, job.BY_SPECIALTY, job.BY_PORTAL, job.BY_SOCIAL_RISK,
        "journeys_observed", "scored_journeys", "outreach", "model", "scored_all_journeys",
    }
    assert expected <= set(os.listdir(output))


def test_reports_agree_with_each_other(spark, output):
    summary = spark.read.option("header", True).csv(f"{output}/{job.SUMMARY}").first()
    assert int(summary["diabetes_journeys_observed365"]) == 216
    by_type = read_report(
        spark, f"{output}/{job.BY_TYPE}",
        "FirstEncounterType string, journeys bigint, patients bigint, rate double, median double",
    ).collect()
    assert sum(r["journeys"] for r in by_type) == 216
    metrics = spark.read.option("header", True).csv(f"{output}/{job.METRICS}").first()
    assert int(metrics["train_rows"]) + int(metrics["test_rows"]) == 174
    assert int(metrics["train_rows"]) == int(0.75 * 174)
    assert metrics["removed_first_encounter_year"] == "TRUE"
    cells = spark.read.option("header", True).csv(f"{output}/{job.CONFUSION}").collect()
    assert sum(int(r["Freq"]) for r in cells) == int(metrics["test_rows"])
    tiers = spark.read.option("header", True).csv(f"{output}/{job.TIERS}").collect()
    assert sum(int(r["journeys"]) for r in tiers) == int(metrics["test_rows"])
    assert metrics["observation_filter"] == "ObservationDays >= 365"
    every = spark.read.parquet(f"{output}/scored_all_journeys")
    journeys = eligible(spark.read.parquet(f"{output}/journeys_observed"))
    complete = journeys.na.drop("any", subset=list(FEATURES)).count()
    assert every.count() == complete
    tested = spark.read.parquet(f"{output}/scored_journeys")
    same = tested.join(every, ["JourneyKey", "predicted_probability", "risk_group"])
    assert same.count() == tested.count()
    outreach = spark.read.parquet(f"{output}/outreach").count()
    assert outreach == every.filter("risk_group = 'High'").count()


def test_options_of_the_model_rows(spark, output):
    journeys = eligible(spark.read.parquet(f"{output}/journeys_observed"))
    options = job.JobSettings(
        label="LongGap365", sample_rows=100, split_by="PatientDurableKey", lump_on_train_only=True
    )
    rows, _ = job.prepare_rows(journeys, options)
    assert rows.count() == 174  # only the rows the forest is fitted on are bounded
    fit = job.training_rows(rows, options)
    assert fit.count() == 100 and fit.filter("split <> 'train'").isEmpty()
    sides = rows.select("PatientDurableKey", "split").distinct()
    assert sides.count() == rows.select("PatientDurableKey").distinct().count()
    assert 100 < rows.filter("split = 'train'").count() <= int(0.75 * 174)
    assert varying_features(rows, "LongGap365")


def test_stored_model_scores_raw_levels_and_dropped_features(spark, output):
    bundle = load_bundle(spark, f"{output}/model")
    assert 0 < len(bundle.forest.features) <= 22
    journeys = eligible(spark.read.parquet(f"{output}/journeys_observed"))
    name = "FirstVisitTypeDescription"
    raw, other = (
        {r["JourneyKey"]: r["predicted_probability"]
         for r in score_journeys(bundle, journeys.withColumn(name, F.lit(level)).drop("LongGap365")).collect()}
        for level in ("never seen", "Other")
    )
    complete = journeys.na.drop("any", subset=[f for f in FEATURES if f != name]).count()
    assert len(raw) == complete and raw == other


def test_command_scores_with_a_stored_model(spark, output, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run(
        [sys.executable, "journey_job.py", "--input", FOLDER, "--output", str(tmp_path / "out"), "--score-with", f"{output}/model"],
        cwd=root, capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"},
    )
    assert done.returncode == 0, done.stderr[-2000:]
    scored, again = (spark.read.parquet(f"{f}/scored_all_journeys").collect() for f in (str(tmp_path / "out"), output))
    assert sorted(scored) == sorted(again)
