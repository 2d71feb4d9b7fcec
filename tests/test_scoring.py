import pytest
from frames import model_rows

from lapsekit.operators import scoring


@pytest.mark.parametrize("local_levels", [10_000, 0])
def test_smoothed_rates(spark, monkeypatch, local_levels):
    monkeypatch.setattr(scoring, "MAX_LOCAL_LEVELS", local_levels)
    train = model_rows(spark, 40, lambda i: int(i < 10), OmbRace=lambda i: "a" if i < 20 else "b")
    rows = model_rows(spark, 3, lambda i: 0, OmbRace=lambda i: ["a", "b", "new"][i])
    got = scoring.rate_scores(train, rows, ["OmbRace"]).collect()
    scores = {r["OmbRace"]: r["predicted_probability"] for r in got}
    base = 10 / 40
    assert scores == pytest.approx({"a": (10 + 20 * base) / 40, "b": (0 + 20 * base) / 40, "new": base})


def test_no_training_rows(spark):
    frame = model_rows(spark, 2, lambda i: 0)
    with pytest.raises(ValueError):
        scoring.rate_scores(frame.limit(0), frame, ["OmbRace"])
