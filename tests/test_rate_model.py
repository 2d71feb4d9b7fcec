"""The rate model as a table, numbering, and importance of any score."""

import hashlib
import random

import pytest
from frames import model_rows
from pyspark.sql import functions as F

from lapsekit.operators import evaluate
from lapsekit.operators.importance import exchange_shift, permutation_importance
from lapsekit.operators.lumping import fit_lumping
from lapsekit.operators.numbering import numbered
from lapsekit.operators.rate_model import SCHEMA, rate_model, score_by_model
from lapsekit.operators.scoring import rate_scores
from lapsekit.plans import queries as registered
from lapsekit.session import stage

KEYS = ("FirstDepartmentSpecialty", "OmbRace")


@pytest.fixture(scope="module")
def rows(spark):
    return model_rows(
        spark, 400, lambda i: int(i % 5 < 2),
        FirstDepartmentSpecialty=lambda i: f"s{min(i % 41, 40 - i % 3)}", OmbRace=lambda i: None if i % 50 == 0 else f"r{i % 4}",
    )


def test_stored_model_scores_as_the_rates_do(spark, rows, tmp_path):
    limits = {"FirstDepartmentSpecialty": 10, "OmbRace": 15}
    lumping = fit_lumping(rows, limits)
    train = lumping.apply(rows.filter("PatientDurableKey % 4 > 0"))
    model = rate_model(train, KEYS, lumping, (0.39, 0.41))
    assert model.schema.simpleString() == f"struct<{SCHEMA.replace(', ', ',').replace(' ', ':')}>"
    model.write.parquet(str(tmp_path / "model"))
    # A second table: other journeys, a level never seen, no label.
    second = rows.drop("LongGap180").withColumn(
        "FirstDepartmentSpecialty", F.when(F.col("JourneyKey") == "j00007", "never seen").otherwise(F.col("FirstDepartmentSpecialty"))
    )
    got = {r["JourneyKey"]: r for r in score_by_model(spark.read.parquet(str(tmp_path / "model")), second, KEYS).collect()}
    expected = rate_scores(train, lumping.apply(second), KEYS).collect()
    assert len(got) == len(expected) == 400
    for r in expected:
        score = r["predicted_probability"]
        assert got[r["JourneyKey"]]["predicted_probability"] == pytest.approx(score, abs=1e-12)
        tier = "Low" if score < 0.39 else "Medium" if score < 0.41 else "High"
        assert got[r["JourneyKey"]]["risk_group"] == tier
    assert {r["risk_group"] for r in got.values()} == {"Low", "Medium", "High"}


@pytest.mark.parametrize("limit", [0, 10_000])
def test_model_with_many_levels_is_joined(spark, rows, limit, monkeypatch):
    lumping = fit_lumping(rows, {"FirstDepartmentSpecialty": 60})
    model = stage(rate_model(rows, KEYS[:1], lumping, (0.1, 0.2)), "model")
    expected = {tuple(r) for r in score_by_model(model, rows, KEYS[:1]).collect()}
    monkeypatch.setattr("lapsekit.operators.scoring.MAX_LOCAL_LEVELS", limit)
    assert {tuple(r) for r in score_by_model(model, rows, KEYS[:1]).collect()} == expected


def test_nothing_to_score(spark, rows):
    model = stage(rate_model(rows, KEYS, fit_lumping(rows, {k: 5 for k in KEYS}), (None, None)), "model")
    assert score_by_model(model, rows.limit(0), KEYS).collect() == []
    assert {r["risk_group"] for r in score_by_model(model, rows, KEYS).collect()} == {"High"}


@pytest.mark.parametrize("partitions", [1, 6])
def test_numbers_follow_the_order(spark, partitions):
    values = list(range(1000))
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(v % 13, v) for v in values], "a int, b int").repartition(partitions)
    got = {(r["a"], r["b"]): r["place"] for r in numbered(df, [F.desc("a"), F.asc("b")]).collect()}
    assert [got[key] for key in sorted(got, key=lambda k: (-k[0], k[1]))] == list(range(1000))
    assert numbered(df.limit(0), [F.asc("a")]).collect() == []


def test_importance_of_a_linear_score(spark):
    """By hand: score = x / 10 + z, label y; idle is not used, one row in three has a null."""
    rng = random.Random(5)
    data = [(f"k{i}", rng.randrange(2), rng.randrange(10), rng.random(), None if i % 3 == 0 else i) for i in range(101)]
    df = spark.createDataFrame(data, "JourneyKey string, LongGap180 int, x int, z double, idle int")
    score = lambda frame: frame.withColumn(evaluate.SCORE, F.col("x") / 10 + F.col("z"))
    got = {r["variable"]: r["importance"] for r in permutation_importance(df, ["x", "z", "idle"], score).collect()}
    rows = sorted(data, key=lambda r: (hashlib.md5(f"123:exchange:{r[0]}".encode()).hexdigest(), r[0]))
    n = len(rows)

    def error(shift_x, shift_z):
        return sum((y - rows[(i + shift_x) % n][2] / 10 - rows[(i + shift_z) % n][3]) ** 2 for i, (_, y, *_) in enumerate(rows)) / n

    assert got["x"] == pytest.approx(error(exchange_shift("x", n), 0) - error(0, 0), abs=1e-12)
    assert got["z"] == pytest.approx(error(0, exchange_shift("z", n)) - error(0, 0), abs=1e-12)
    assert got["idle"] == 0.0
    assert permutation_importance(df.limit(1), ["x"], score).collect()[0]["importance"] == 0.0


def test_shifts_differ_and_move_every_row():
    shifts = [exchange_shift(f"f{i}", 1000) for i in range(30)]
    assert len(set(shifts)) > 25 and all(0 < s < 1000 for s in shifts)
    assert exchange_shift("f", 1) == 0 and exchange_shift("f", 2) == 1


def test_real_label_entries_agree_with_their_scores(spark):
    """Metrics and tiers of the forest on the real label, computed again from the scores it emits."""
    folder = "/root/testdata/sf0.001"
    scores = [(r["LongGap365"], r["predicted_probability"]) for r in registered.queries()["rf_real_scores"](spark, folder).collect()]
    assert all(0 <= p <= 1 for _, p in scores) and len({p for _, p in scores}) > 1
    metrics = registered.queries()["rf_real_metrics"](spark, folder).first()
    pairs = [(a > b) + (a == b) / 2 for y, a in scores if y for z, b in scores if not z]
    assert metrics["auc"] == pytest.approx(sum(pairs) / len(pairs), abs=1e-8)
    assert metrics["accuracy"] == pytest.approx(sum((p >= 0.5) == y for y, p in scores) / len(scores), abs=1e-8)
    ordered = sorted(p for _, p in scores)

    def cut(share):
        at = share * (len(ordered) - 1)
        low = int(at)
        return ordered[low] + (at - low) * (ordered[min(low + 1, len(ordered) - 1)] - ordered[low])

    low, high = cut(1 / 3), cut(2 / 3)
    for r in registered.queries()["rf_real_risk_tiers"](spark, folder).collect():
        own = [(y, p) for y, p in scores if r["risk_group"] == ("Low" if p < low - 1e-9 else "Medium" if p < high - 1e-9 else "High")]
        assert r["journeys"] == len(own)
        assert r["actual_long_gap_365_rate"] == pytest.approx(sum(y for y, _ in own) / len(own), abs=1e-8)
