import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from lapsekit.operators import evaluate

SCHEMA = "JourneyKey string, PatientDurableKey bigint, LongGap180 int, predicted_probability double"


def _scored(spark, pairs):
    rows = [(f"j{i}", i, y, p) for i, (y, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _pairs(n, digits, seed):
    rng = random.Random(seed)
    return [(rng.randrange(2), round(rng.random(), digits)) for _ in range(n)]


def _brute_auc(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("ranges", [2, 3, 512])
@pytest.mark.parametrize("digits", [1, 8])
def test_auc_is_the_share_of_ordered_pairs(spark, monkeypatch, ranges, digits):
    monkeypatch.setattr(evaluate, "SCORE_RANGES", ranges)
    pairs = _pairs(200, digits, ranges + digits)
    got = evaluate.roc_auc(_scored(spark, pairs)).first()["auc"]
    assert got == pytest.approx(_brute_auc(pairs), abs=1e-12)


def test_auc_equals_the_exact_evaluator_and_reverses(spark):
    pairs = _pairs(2_000, 3, 5)
    scored = _scored(spark, pairs)
    got = evaluate.roc_auc(scored).first()["auc"]
    exact = BinaryClassificationEvaluator(
        rawPredictionCol="predicted_probability", labelCol="label", metricName="areaUnderROC", numBins=0
    ).evaluate(scored.withColumn("label", F.col("LongGap180").cast("double")))
    assert got == pytest.approx(exact, abs=1e-12)
    reverse = scored.withColumn("predicted_probability", 1 - F.col("predicted_probability"))
    assert evaluate.roc_auc(reverse).first()["auc"] == pytest.approx(1 - got, abs=1e-9)


def test_auc_of_one_class_is_null(spark):
    assert evaluate.roc_auc(_scored(spark, [(1, 0.2), (1, 0.4)])).first()["auc"] is None
    assert evaluate.roc_auc(_scored(spark, [])).first()["auc"] is None


def test_confusion_has_four_cells_and_half_counts_as_gap(spark):
    scored = _scored(spark, [(1, 0.5), (1, 0.9), (0, 0.5)])
    got = [(r["actual"], r["predicted"], r["Freq"]) for r in evaluate.confusion_matrix(scored).collect()]
    assert got == [
        ("NoLongGap", "NoLongGap", 0), ("LongGap", "NoLongGap", 0),
        ("NoLongGap", "LongGap", 1), ("LongGap", "LongGap", 2),
    ]


def test_metrics_row(spark):
    pairs = _pairs(100, 2, 3)
    row = evaluate.metrics(_scored(spark, pairs), 300).first()
    assert (row["test_rows"], row["train_rows"]) == (100, 300)
    assert row["accuracy"] == pytest.approx(sum((p >= 0.5) == (y == 1) for y, p in pairs) / 100)
    assert row["removed_first_encounter_year"] is True


def test_equal_scores_share_a_tier(spark):
    scored = _scored(spark, [(0, 0.1)] * 2 + [(1, 0.5)] * 6 + [(1, 0.9)])
    tiers = {r["predicted_probability"]: r["risk_group"] for r in evaluate.with_risk_tier(scored).collect()}
    assert tiers == {0.1: "Low", 0.5: "High", 0.9: "High"}


def test_tiers_follow_the_score(spark):
    tiered = evaluate.with_risk_tier(_scored(spark, _pairs(300, 6, 9)))
    report = evaluate.risk_tier_report(tiered).collect()
    assert [r["risk_group"] for r in report] == ["Low", "Medium", "High"]
    assert sum(r["journeys"] for r in report) == 300
    means = [r["average_predicted_probability"] for r in report]
    assert means == sorted(means)
    outreach = evaluate.outreach_list(tiered).collect()
    assert len(outreach) == report[2]["journeys"]
    scores = [r["predicted_probability"] for r in outreach]
    assert scores == sorted(scores, reverse=True)


def test_rows_without_a_score_are_in_no_class_tier_list_or_curve(spark):
    rows = [("a", "p", 1, 0.9), ("b", "p", 0, 0.1), ("c", "p", 1, None), ("d", "p", 0, float("nan"))]
    scored = spark.createDataFrame(
        rows, "JourneyKey string, PatientDurableKey string, LongGap180 int, predicted_probability double"
    )
    assert sum(r["Freq"] for r in evaluate.confusion_matrix(scored).collect()) == 2
    assert evaluate.roc_auc(scored).first()["auc"] == 1.0
    got = evaluate.metrics(scored, 0).first()
    assert (got["auc"], got["accuracy"], got["test_rows"]) == (1.0, 1.0, 4)
    high = evaluate.outreach_list(evaluate.with_risk_tier(scored)).collect()
    assert [r["JourneyKey"] for r in high] == ["a"]
