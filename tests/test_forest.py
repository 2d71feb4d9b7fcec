import hashlib

import pytest
from frames import model_rows
from pyspark.sql import functions as F

from lapsekit.operators import evaluate, forest, ranking
from lapsekit.operators.importance import exchange_shift
from lapsekit.operators.frame import varying_features
from lapsekit.plans import queries as registered
from lapsekit.settings import FEATURES

SMALL = forest.ForestSettings(trees=20, max_depth=5, min_node_size=5)


@pytest.fixture(scope="module")
def planted(spark):
    """The label follows the specialty; sex and food risk are noise."""
    frame = model_rows(
        spark, 1_200, lambda i: int(i * 7919 % 12 < 6),
        FirstDepartmentSpecialty=lambda i: f"s{i * 7919 % 12}",
        SexAssignedAtBirth=lambda i: "FM"[i * 31 % 97 % 2],
        FoodRisk=lambda i: i * 17 % 89 % 2,
    )
    return frame.withColumn(
        "split", F.when(F.xxhash64("JourneyKey") % 4 == 0, "test").otherwise("train")
    ).cache()


@pytest.fixture(scope="module")
def fitted(planted):
    train = planted.filter("split = 'train'")
    return forest.train_forest(train, varying_features(planted), settings=SMALL)


def test_planted_signal_is_found(planted, fitted):
    test = planted.filter("split = 'test'")
    scored = forest.score(fitted, test)
    assert scored.count() == test.count()
    assert evaluate.roc_auc(scored).first()["auc"] > 0.99
    importance = {r["variable"]: r["importance"] for r in forest.permutation_importance(fitted, test).collect()}
    assert max(importance, key=importance.get) == "FirstDepartmentSpecialty"
    assert importance["FirstDepartmentSpecialty"] > 0.1
    assert abs(importance["FoodRisk"]) < 0.02 and abs(importance["SexAssignedAtBirth"]) < 0.02
    assert set(importance) == set(fitted.features)


def test_importance_does_not_depend_on_partitions(planted, fitted):
    test = planted.filter("split = 'test'")
    one, many = (
        {r["variable"]: r["importance"] for r in forest.permutation_importance(fitted, df).collect()}
        for df in (test.coalesce(1), test.repartition(9))
    )
    assert one == pytest.approx(many, abs=1e-9)


def test_importance_equals_exchanging_one_feature_at_a_time(spark, planted, fitted):
    test = planted.filter("split = 'test'")
    got = {r["variable"]: r["importance"] for r in forest.permutation_importance(fitted, test).collect()}
    assert max(got, key=got.get) == "FirstDepartmentSpecialty"
    rows = [r.asDict() for r in test.collect()]
    rows.sort(key=lambda r: (hashlib.md5(f"123:exchange:{r['JourneyKey']}".encode()).hexdigest(), r["JourneyKey"]))
    columns = ["LongGap180", *FEATURES]

    def squared_error(values):
        frame = spark.createDataFrame([tuple(r[c] for c in columns) for r in values], test.select(columns).schema)
        return forest.score(fitted, frame).select(F.avg(F.pow(F.col("LongGap180") - F.col(evaluate.SCORE), 2))).first()[0]

    base = squared_error(rows)
    for name in ("FirstDepartmentSpecialty", "SexAssignedAtBirth", "FoodRisk"):
        shift = exchange_shift(forest._indexed(name), len(rows))
        assert 0 < shift < len(rows)
        swapped = [r | {name: rows[(i + shift) % len(rows)][name]} for i, r in enumerate(rows)]
        assert got[name] == pytest.approx(squared_error(swapped) - base, abs=1e-12)


def test_unused_and_idle_features_are_zero(planted):
    train = planted.filter("split = 'train'")
    small = forest.train_forest(train, ["FirstDepartmentSpecialty", "OmbRace"], settings=forest.ForestSettings(trees=3, max_depth=3))
    got = {r["variable"]: r["importance"] for r in forest.permutation_importance(small, planted.filter("split = 'test'")).collect()}
    assert got["OmbRace"] == 0.0 and got["FirstDepartmentSpecialty"] > 0.1


def test_same_rows_give_the_same_forest_on_any_session(spark, planted):
    """Input files, shuffle partitions and cores don't matter: the partitions of the fit follow from the rows."""
    train = planted.filter("split = 'train'")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    trees = []
    try:
        for df, partitions, split in ((train.coalesce(1), "4", "128m"), (train.repartition(7), "8", "16k"), (train, "3", "1m")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            fitted = forest.train_forest(df, ["FirstDepartmentSpecialty", "FoodRisk", "SexAssignedAtBirth"], settings=SMALL)
            trees.append(fitted.model.stages[-1].toDebugString.split("\n")[1:])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert trees[0] == trees[1] == trees[2]


def test_unseen_level_is_scored_and_forest_survives_storage(spark, planted, fitted, tmp_path):
    row = planted.limit(1).withColumn("FirstDepartmentSpecialty", F.lit("never seen"))
    assert forest.score(fitted, row).count() == 1
    forest.save_forest(fitted, str(tmp_path / "forest"))
    loaded = forest.load_forest(spark, str(tmp_path / "forest"))
    assert (loaded.features, loaded.label) == (fitted.features, fitted.label)
    test = planted.filter("split = 'test'")
    score = {r["JourneyKey"]: r["predicted_probability"] for r in forest.score(fitted, test).collect()}
    again = {r["JourneyKey"]: r["predicted_probability"] for r in forest.score(loaded, test).collect()}
    assert score == again


def test_scoring_tasks_are_even_and_bounded():
    assert [forest.scoring_tasks(n, 12) for n in (0, 1, 1_001, 11_000, 26_672)] == [1, 1, 2, 11, 12]
    assert [forest.scoring_tasks(n, 12) for n in (600_000, 600_001, 1_600_000)] == [12, 24, 36]


def test_one_file_is_scored_in_even_tasks(spark, planted, fitted, monkeypatch):
    """A hot key and input partitions folded into one: the shares are equal, the scores those of the plain way."""
    monkeypatch.setattr(forest, "LEAST_SCORED", 50)
    test = planted.filter("split = 'test'").withColumn("PatientDurableKey", F.lit(1)).coalesce(1)
    slots, n = spark.sparkContext.defaultParallelism, test.count()
    tasks = min(slots, -(-n // 50))
    dealt = forest.score(fitted, forest.dealt_evenly(test))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(sizes) == tasks > 1 and sum(sizes) == n and max(sizes) - min(sizes) <= slots  # input partitions
    columns = ["JourneyKey", evaluate.SCORE]
    assert sorted(dealt.select(columns).collect()) == sorted(forest.score(fitted, test).select(columns).collect())
    assert forest.score(fitted, forest.dealt_evenly(test.limit(0))).collect() == []


def test_registered_scores_are_dealt_evenly(spark, monkeypatch):
    """The stored scores of both forests come from as many equal tasks as there are slots, not from the frame's files."""
    monkeypatch.setattr(forest, "LEAST_SCORED", 5)
    monkeypatch.setattr(registered, "FOREST", SMALL)
    monkeypatch.setattr(registered, "PLANTED_FOREST", SMALL)
    monkeypatch.setattr(registered, "_forests", {})
    monkeypatch.setattr(registered, "stored", lambda spark, folder, name, build: build())
    for scored in (registered.forest_scored_test, registered.planted_scored_test):
        rows = scored(spark, "/root/testdata/sf0.001")
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) - min(sizes) <= 2


def test_no_depth_makes_enough_passes_for_a_checkpoint(fitted):
    """The node ids, a number per training row and tree, are not written for the one or two passes that may follow."""
    deepest = 30
    assert fitted.model.stages[-1].getOrDefault("checkpointInterval") > deepest + 1


def test_split_gain_importance_names_every_feature(spark, fitted):
    gains = {r["variable"]: r["importance"] for r in forest.gini_importance(fitted, spark).collect()}
    assert set(gains) == set(fitted.features)
    assert max(gains, key=gains.get) == "FirstDepartmentSpecialty"


def test_more_levels_than_default_bins(spark):
    frame = model_rows(spark, 400, lambda i: i % 2, FirstVisitTypeDescription=lambda i: f"v{i % 60}")
    got = forest.train_forest(
        frame, ["FirstVisitTypeDescription"], settings=forest.ForestSettings(trees=2, max_depth=3)
    )
    assert got.model.stages[-1].getOrDefault("maxBins") >= 61


def test_one_class_cannot_be_learned(spark):
    with pytest.raises(ValueError):
        forest.train_forest(model_rows(spark, 10, lambda i: 1), ["FoodRisk"], settings=SMALL)


def test_rate_spread_finds_the_planted_feature(planted):
    got = ranking.rate_spread_importance(planted).orderBy(F.desc("importance")).first()
    assert got["variable"] == "FirstDepartmentSpecialty"
    assert got["importance"] == pytest.approx(0.25, abs=0.01)


def test_rate_spread_beyond_what_a_bigint_product_holds(spark):
    big = 4_000_000_000
    frame = spark.createDataFrame([("a", big), ("b", 0)], "FoodRisk string, LongGap180 bigint")
    got = ranking.rate_spread_importance(frame, features=["FoodRisk"]).first()["importance"]
    assert got == pytest.approx((big / 2) ** 2)


def test_top_lists_with_and_without_ties(spark):
    rows = [(name, 1.0 if i < 9 else 0.5) for i, name in enumerate(FEATURES)]
    table = spark.createDataFrame(rows, "variable string, importance double")
    assert ranking.top_importance(table, 15).count() == 15
    top = ranking.top_predictors(table, 10).collect()
    assert len(top) == len(FEATURES)
    assert [r["rank"] for r in top] == list(range(1, len(FEATURES) + 1))
    names = {r["variable"]: (r["title"], r["display_name"]) for r in top}
    assert names["SdohDomainsAnswered"] == ("Sdoh Domains Answered", "SDOH Domains Answered")
    assert names["OmbRace"] == ("Omb Race", "Omb Race")
    assert ranking.top_predictors(table, 9).count() == 9
