import math

import pytest

from lapsekit.operators.histogram import histogram


def _bins(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "x int")
    return [(r["bin_lo"], r["bin_hi"], r["journeys"]) for r in histogram(df, "x", bins).collect()]


def test_empty_bins_are_kept_and_all_rows_counted(spark):
    values = [0, 1, 2, 100, 100, None]
    got = _bins(spark, values, 11)
    assert len(got) == 11
    assert sum(n for *_, n in got) == 5
    assert [n for *_, n in got] == [3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2]
    assert got[0][:2] == (-5.0, 5.0)


def test_a_value_on_an_edge_belongs_to_the_lower_bin(spark):
    # Width 10, edges at 5, 15, 25.
    got = _bins(spark, [0, 5, 6, 15, 20], 3)
    assert [n for *_, n in got] == [2, 2, 1]


def test_equal_values_make_one_bin(spark):
    got = _bins(spark, [7, 7, 7], 45)
    assert len(got) == 1
    lo, hi, n = got[0]
    assert lo < 7 <= hi and n == 3


def test_no_rows_no_bins(spark):
    assert _bins(spark, [None], 45) == []
    with pytest.raises(ValueError):
        _bins(spark, [1], 1)


def test_groups_share_edges(spark):
    df = spark.createDataFrame([(x, x > 180 or None) for x in range(0, 1461, 7)], "x int, g boolean")
    got = histogram(df, "x", 55, by=["g"]).collect()
    assert len(got) == 2 * 55
    edges = {r["bin_lo"] for r in got}
    assert len(edges) == 55
    assert sum(r["journeys"] for r in got) == df.count()
    width = 1456 / 54
    for r in got:
        expected = sum(
            1 for x in range(0, 1461, 7) if (x > 180 or None) == r["g"] and math.ceil(x / width - 0.5 - 1e-8) == r["bin"]
        )
        assert r["journeys"] == expected
