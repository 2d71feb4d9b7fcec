import pytest
from pyspark.sql import functions as F

from lapsekit.functions import labels


def _one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "expression, value, expected",
    [
        (labels.truncated, "a" * 45, "a" * 45),
        (labels.truncated, "a" * 46, "a" * 42 + "..."),
        (labels.truncated, None, None),
        (labels.spaces_for_underscores, "a_b__c", "a b  c"),
        (labels.split_capitals, "SdohDomainsAnswered", "Sdoh Domains Answered"),
        (labels.split_capitals, "ABC", "A B C"),
        (labels.trimmed, "\t a b \n", "a b"),
        (labels.squished, " a \t b\n", "a b"),
        (labels.title_case, "has sdoh SCREENING", "Has Sdoh Screening"),
        (labels.title_case, "sdoh-screening", "Sdoh-Screening"),
    ],
)
def test_text(spark, expression, value, expected):
    assert _one(spark, expression, value) == expected


@pytest.mark.parametrize(
    "rate, expected",
    [(0.85, "85%"), (0.748, "74.8%"), (1.0, "100%"), (0.0, "0%"), (0.0025, "0.2%"), (0.0035, "0.4%"), (None, "NA%")],
)
def test_percent_rounds_half_to_even_and_drops_zero(spark, rate, expected):
    assert _one(spark, labels.percent_label, rate, "double") == expected


@pytest.mark.parametrize("change, expected", [(0.0213, "+2.1%"), (-0.0213, "-2.1%"), (0.0, "+0%"), (-0.0003, "0%")])
def test_change_carries_its_own_sign(spark, change, expected):
    assert _one(spark, labels.change_label, change, "double") == expected


def test_recodes(spark):
    groups = {"Activated": "on", "Pending": "on", "Declined": "off"}
    for value, expected in (("Pending", "on"), ("Declined", "off"), ("?", None), (None, None)):
        assert _one(spark, lambda c: labels.group_of(c, groups), value) == expected
    names = {0: "No", 1: "Yes"}
    for code, expected in ((0, "No"), (1, "Yes"), (2, None), (None, None)):
        assert _one(spark, lambda c: labels.named_codes(c, names), code, "int") == expected
    for value, expected in (("a", "b"), ("z", "z"), (None, None)):
        assert _one(spark, lambda c: labels.renamed(c, {"a": "b"}), value) == expected
    assert _one(spark, lambda c: labels.level_position(c, ("Low", "High")), "High") == 2


@pytest.mark.parametrize(
    "value, expected",
    [
        (0.0005, "0.0005"), (1e8, "100000000"), (0.1, "0.1"), (-3.5e-6, "-0.0000035"), (12345678.25, "12345678.25"),
        (3.0, "3"), (0.0, "0"), (1e-20, "1.0E-20"), (None, None), (1.2345678901234568e-05, "0.000012345678901234568"),
    ],
)
def test_plain_numbers(spark, value, expected):
    text = _one(spark, labels.plain_number, value, "double")
    assert text == expected
    if text is not None:
        assert float(text) == value
