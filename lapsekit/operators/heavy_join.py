"""A join to a table of unique keys that holds when one key has a large share of the rows.

Spark's own handling of skew splits a hot partition by the map tasks that wrote
it, so rows that one task wrote stay together. Here hot keys are found before
the join, and their rows meet a copy of the few lookup rows where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot from this share of the rows; about as many sampled rows tell the keys that are.
HOT_SHARE, SAMPLED_ROWS = 1 / 1_000, 200_000
#: Tables with no more rows are joined as they are: no task can get more than that.
LEAST_ROWS = 1_000_000


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE, sampled: int = SAMPLED_ROWS, least: int = LEAST_ROWS) -> list:
    """Values of ``key`` that have about ``share`` of the rows or more; at most twice the inverse of ``share``.

    They are told by a sample, which decides how rows are joined and never which.
    """
    n = rows.count()
    if n <= max(least, 0):
        return []
    sample = rows.select(key).filter(F.col(key).isNotNull()).sample(min(1.0, sampled / n), seed=1)
    limit = max(2, int(min(n, sampled) * share / 2))
    return [row[key] for row in sample.groupBy(key).count().filter(F.col("count") >= limit).select(key).collect()]


def join_unique(rows: DataFrame, lookup: DataFrame, key: str, lookup_key: str, **options) -> DataFrame:
    """Inner join of ``rows`` to ``lookup``, which has each ``lookup_key`` once; ``rows`` is read twice if a key is hot."""
    hot = hot_keys(rows, key, **options)
    on = F.col(key) == F.col(lookup_key)
    if not hot:
        return rows.join(lookup, on)
    is_hot, few = F.col(key).isin(hot), lookup.filter(F.col(lookup_key).isin(hot))
    return rows.filter(~is_hot).join(lookup, on).unionByName(rows.filter(is_hot).join(F.broadcast(few), on))
