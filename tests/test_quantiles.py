from fractions import Fraction

import numpy as np
import pytest

from lapsekit.operators import quantiles

THIRDS = [Fraction(1, 3), Fraction(2, 3)]


def _frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "p double").repartition(3)


@pytest.fixture(params=["on the driver", "in ranges"])
def steps(request, monkeypatch):
    if request.param == "in ranges":
        monkeypatch.setattr(quantiles, "MAX_DRIVER_VALUES", 1)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 100, 301])
def test_equal_to_linear_interpolation(spark, steps, n, seed):
    values = np.random.default_rng(seed).random(n).round(2 if seed == 2 else 12)
    got = quantiles.exact_quantiles(_frame(spark, values), "p", THIRDS)
    assert got == pytest.approx(list(np.quantile(values, [1 / 3, 2 / 3])), abs=1e-12)


def test_many_equal_values(spark, steps):
    values = [0.5] * 300 + [0.1, 0.9]
    assert quantiles.exact_quantiles(_frame(spark, values), "p", THIRDS) == [0.5, 0.5]


def test_a_quantile_on_a_value_is_that_value(spark, steps):
    values = [i / 10 for i in range(10)]
    assert quantiles.exact_quantiles(_frame(spark, values), "p", THIRDS) == [0.3, 0.6]


def test_missing_values_are_left_out(spark):
    assert quantiles.exact_quantiles(_frame(spark, [None, 1, float("nan"), 1]), "p", THIRDS) == [1.0, 1.0]
    assert quantiles.exact_quantiles(_frame(spark, [None]), "p", THIRDS) == [None, None]
    assert quantiles.exact_quantiles(_frame(spark, [1]), "p", []) == []


def test_values_of_very_different_size(spark, steps):
    values = [10.0 ** -k for k in range(0, 30)]
    got = quantiles.exact_quantiles(_frame(spark, values), "p", [Fraction(1, 2)])
    assert got == pytest.approx([float(np.quantile(values, 0.5))])


def test_infinite_values(spark, steps):
    values = [float("-inf")] * 4 + [1.0, 2.0, 3.0] + [float("inf")] * 4
    asked = [Fraction(1, 10), Fraction(1, 2), Fraction(9, 10)]
    assert quantiles.exact_quantiles(_frame(spark, values), "p", asked) == [float("-inf"), 2.0, float("inf")]


def _numbers(spark, n, value):
    return spark.range(0, n, 1, 6).selectExpr(f"cast({value} as double) AS p")


@pytest.mark.parametrize("value", ["id * 7919 % 200003", "pow(id % 1000, 3)", "if(id % 3 = 0, 0, id)", "-exp(id / 5000)"])
def test_brackets_of_a_larger_table_give_the_same(spark, monkeypatch, value):
    """Beyond the driver's limit the sketch sets brackets; the result is that of all rows sorted."""
    df = _numbers(spark, 60_000, value)
    asked = [Fraction(0), Fraction(1, 100), Fraction(1, 3), Fraction(1, 2), Fraction(2, 3), Fraction(9999, 10_000), Fraction(1)]
    expected = np.quantile(np.array([r.p for r in df.collect()]), [float(p) for p in asked])
    assert quantiles.exact_quantiles(df, "p", asked) == pytest.approx(list(expected), rel=1e-9)
    monkeypatch.setattr(quantiles, "MAX_DRIVER_VALUES", 5)
    assert quantiles.exact_quantiles(df, "p", asked) == pytest.approx(list(expected), rel=1e-9)


def test_rows_are_read_twice_and_few_values_are_kept(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    kept = []
    counted = quantiles._counted

    def watched(values, brackets):
        table = counted(values, brackets)
        kept.append(table.count())
        return table

    monkeypatch.setattr(quantiles, "_counted", watched)
    n = 200_000
    df = _numbers(spark, n, "id * 7919 % 200003").mapInArrow(count, "p double")
    quantiles.exact_quantiles(df, "p", THIRDS)
    assert read.value == 2 * n
    # Two brackets of a sketch's reach, its error on both ends, and three regions without values.
    most = 2 * n * (2 * quantiles.REACH + 2) // quantiles.SKETCH_ACCURACY + 3
    assert kept == [pytest.approx(most / 2, abs=most / 2)]


def test_a_bracket_that_misses_is_made_good(spark, monkeypatch):
    summary = quantiles._summary

    def wrong(values, probabilities):
        s = summary(values, probabilities)
        return quantiles._Summary(s.rows, s.whole, (quantiles._Bracket(0.0, 1.0),) * len(s.brackets))

    monkeypatch.setattr(quantiles, "_summary", wrong)
    df = _numbers(spark, 1_001, "id")
    assert quantiles.exact_quantiles(df, "p", [Fraction(1, 2), Fraction(3, 4)]) == [500.0, 750.0]
