"""Text and label expressions for reports. All are lazy columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def truncated(text: Column, width: int = 45, ellipsis: str = "...") -> Column:
    """``text`` cut to ``width`` characters, the ellipsis included."""
    kept = F.substring(text, 1, width - len(ellipsis))
    return F.when(F.length(text) > width, F.concat(kept, F.lit(ellipsis))).otherwise(text)


def spaces_for_underscores(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(" "))


def split_capitals(text: Column) -> Column:
    """A space before each capital letter that is not the first character."""
    return F.regexp_replace(text, "(?<=.)([A-Z])", " $1")


def trimmed(text: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def squished(text: Column) -> Column:
    """Trimmed, and inner white space runs made one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title_case(text: Column) -> Column:
    """First letter of each word upper, the rest lower, by Unicode word rules."""
    return F.collate(F.initcap(F.collate(text, "UNICODE")), "UTF8_BINARY")


def renamed(text: Column, names: Mapping[str, str]) -> Column:
    """Value by value replacement; a value without a name stays."""
    return F.coalesce(_looked_up(text, names), text)


def named_codes(code: Column, names: Mapping[int, str]) -> Column:
    """Label of a code; a code without a label becomes null."""
    return _looked_up(code.cast("int"), names)


def _looked_up(value: Column, names: Mapping) -> Column:
    found = F.lit(None).cast("string")
    for key, name in names.items():
        found = F.when(value == F.lit(key), F.lit(name)).otherwise(found)
    return found


def group_of(value: Column, groups: Mapping[str, str]) -> Column:
    """Recode many values into few groups; a value outside all groups is null."""
    members: dict[str, list[str]] = {}
    for member, group in groups.items():
        members.setdefault(group, []).append(member)
    recoded = F.lit(None).cast("string")
    for group, listed in members.items():
        recoded = F.when(value.isin(listed), group).otherwise(recoded)
    return recoded


def level_position(value: Column, levels: Sequence) -> Column:
    """Place of a value in an explicit level list, from 1; null when not listed."""
    place = F.lit(None).cast("int")
    for at, level in enumerate(levels, start=1):
        place = F.when(value == F.lit(level), F.lit(at)).otherwise(place)
    return place


def _number_text(number: Column) -> Column:
    return F.regexp_replace(number.cast("string"), r"\.0$", "")


def percent_label(rate: Column) -> Column:
    """``0.85`` -> ``85%``, ``0.748`` -> ``74.8%``; a missing rate reads ``NA%``."""
    return F.concat(F.coalesce(_number_text(F.bround(rate * 100, 1)), F.lit("NA")), F.lit("%"))


def change_label(difference: Column) -> Column:
    """A rate difference with its sign: ``+2.1%``. The unit is percentage points."""
    sign = F.when(difference >= 0, "+").otherwise("")
    return F.concat(sign, percent_label(difference))


def whole_days(days: Column) -> Column:
    return F.bround(days, 0).cast("bigint").cast("string")


def plain_number(value: Column) -> Column:
    """A double as text without an exponent, digits unchanged.

    Magnitudes the decimals cannot hold exactly keep their exponent.
    """
    size = F.abs(value)
    text = value.cast("string")
    wide = value.cast("decimal(38,10)").cast("string")
    fine = value.cast("decimal(38,30)").cast("string")
    plain = (
        F.when((size >= 1e7) & (size < 1e27), wide)
        .when((size < 1e-3) & (size >= 1e-12), fine)
    )
    stripped = F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")
    return F.coalesce(stripped, _number_text(text))
