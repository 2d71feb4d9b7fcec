import hashlib
import math

import pytest
from pyspark.sql import functions as F

from lapsekit.operators import sampling


def _keys(spark, n):
    """Keys, and a group column of which one value holds a third of the rows."""
    return spark.range(n).selectExpr("CONCAT('k', id) AS JourneyKey", "IF(id % 3 = 0, 'hot', CONCAT('p', id)) AS p")


def _digest(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.fixture(params=["one step", "many steps"])
def steps(request, monkeypatch):
    if request.param == "many steps":
        monkeypatch.setattr(sampling, "DIGITS_PER_STEP", 1)
        monkeypatch.setattr(sampling, "MAX_DRIVER_DIGESTS", 2)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 101, 1_000])
def test_split_sizes_are_exact_and_rows_those_of_least_digest(spark, steps, n):
    got = sampling.with_split(_keys(spark, n).repartition(3)).collect()
    train = {r["JourneyKey"] for r in got if r["split"] == "train"}
    expected = sorted((f"k{i}" for i in range(n)), key=lambda k: _digest(123, k))[: math.floor(0.75 * n)]
    assert train == set(expected)
    assert len(got) == n


def test_split_does_not_depend_on_partitions(spark):
    def train(partitions):
        df = sampling.with_split(_keys(spark, 500).repartition(partitions))
        return {r["JourneyKey"] for r in df.filter("split = 'train'").collect()}

    assert train(1) == train(7)


def test_groups_stay_on_one_side(spark, steps):
    df = sampling.with_split(_keys(spark, 900), group_col="p")
    assert df.groupBy("p").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    size = df.filter("split = 'train'").count()
    # Brute force: whole groups in digest order while they fit.
    groups = {}
    for r in _keys(spark, 900).collect():
        groups[r["p"]] = groups.get(r["p"], 0) + 1
    expected = 0
    for name in sorted(groups, key=lambda g: _digest(123, g)):
        if expected + groups[name] > 675:
            break
        expected += groups[name]
    assert size == expected


@pytest.mark.parametrize("cap", [0, 1, 250, 999, 1_000, 2_000, None])
def test_sample_has_exactly_the_cap(spark, steps, cap):
    got = sampling.sample_cap(_keys(spark, 1_000), cap)
    assert got.count() == (1_000 if cap is None else min(cap, 1_000))


def test_sample_and_split_are_drawn_apart(spark):
    df = _keys(spark, 1_000)
    sample = sampling.sample_cap(df, 500)
    split = sampling.with_split(sample, fraction=0.5)
    assert split.filter("split = 'train'").count() == 250
