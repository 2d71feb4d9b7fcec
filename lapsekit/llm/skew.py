"""Joins that hold for keys with a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapsekit.session import stage

#: A key is heavy from this share of all rows, so that there are at most as many as its inverse; and a least number of rows.
HEAVY_SHARE, LEAST = 1 / 100_000, 500


def look_up(rows: DataFrame, answers: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of ``answers`` (one row per ``key``; ``size``: rows that have it); rows without one are left out.

    Both have to be stored. Answers of heavy keys go to the rows, at most
    1 / HEAVY_SHARE of them; only the others are joined by a shuffle.
    """
    limit = max(LEAST, int(rows.count() * HEAVY_SHARE))
    heavy = F.broadcast(stage(answers.filter(F.col(size) > limit), "heavy-answers"))
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(answers.filter(F.col(size) <= limit), key)
    return rows.join(heavy, key).unionByName(rest)
