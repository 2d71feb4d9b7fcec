"""Trees in batches."""

import pytest
from frames import model_rows
from pyspark.sql import functions as F

from lapsekit.operators import evaluate, forest
from lapsekit.operators.ensemble import load_ensemble, score_ensemble, train_ensemble

SETTINGS = forest.ForestSettings(trees=11, max_depth=6, min_node_size=5)
NAMES = ["FirstDepartmentSpecialty", "SexAssignedAtBirth", "FoodRisk"]


@pytest.fixture(scope="module")
def rows(spark):
    return model_rows(
        spark, 800, lambda i: int(i * 7919 % 12 < 6), FirstDepartmentSpecialty=lambda i: f"s{i * 7919 % 12}",
        SexAssignedAtBirth=lambda i: "FM"[i * 31 % 97 % 2], FoodRisk=lambda i: i * 17 % 89 % 2,
    ).cache()


def test_batches_score_as_the_mean_of_all_trees(spark, rows, tmp_path):
    train, test = rows.filter("PatientDurableKey % 4 > 0"), rows.filter("PatientDurableKey % 4 = 0")
    path = str(tmp_path / "trees")
    stored = train_ensemble(train, path, NAMES, settings=SETTINGS, batch=4)
    assert stored.trees == (4, 4, 3) and load_ensemble(spark, path) == stored
    got = {r["JourneyKey"]: r[evaluate.SCORE] for r in score_ensemble(load_ensemble(spark, path), test).collect()}
    assert len(got) == test.count()
    total = dict.fromkeys(got, 0.0)
    for i, trees in enumerate(stored.trees):
        fitted = forest.load_forest(spark, stored.batch_path(i))
        assert fitted.model.stages[-1].getNumTrees == trees
        for r in forest.score(fitted, test).collect():
            total[r["JourneyKey"]] += r[evaluate.SCORE] * trees
    assert got == pytest.approx({k: v / 11 for k, v in total.items()}, abs=1e-12)
    assert evaluate.roc_auc(score_ensemble(stored, test)).first()["auc"] > 0.99


def test_batches_differ_and_follow_the_seed(spark, rows, tmp_path):
    texts = []
    for name in ("a", "b"):
        stored = train_ensemble(rows, str(tmp_path / name), NAMES, settings=SETTINGS, batch=4)
        texts.append([forest.load_forest(spark, stored.batch_path(i)).model.stages[-1].toDebugString.split("\n")[1:] for i in range(2)])
    assert texts[0] == texts[1] and texts[0][0] != texts[0][1]


def test_an_unfinished_ensemble_is_not_read(spark, rows, tmp_path):
    path = str(tmp_path / "trees")
    forest.save_forest(forest.train_forest(rows, NAMES, settings=SETTINGS), f"{path}/batch-00000")
    with pytest.raises(Exception):
        load_ensemble(spark, path)
