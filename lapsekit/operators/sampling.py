"""Exact-size random samples and splits that are the same on every run.

Rows are ordered by a seeded digest of their key and the first ``k`` are taken.
Finding the digest of the k-th row takes a few counting jobs; after that,
membership is a comparison each row makes on its own: no window, no sort and no
shuffle of the rows, and no dependence on how they are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lapsekit.settings import JOURNEY, SEED, TRAIN_FRACTION

# A refinement step splits by this many hex digits, so it counts 4,096 groups.
DIGITS_PER_STEP = 3
DIGEST_DIGITS = 32
# A group with at most this many distinct digests is finished on the driver.
MAX_DRIVER_DIGESTS = 10_000


def digest(key: str, seed: int | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def digest_cutoff(df: DataFrame, order: Column, target: Callable[[int], int]) -> tuple[str, int, int]:
    """The greatest digest for which no more than the target number of rows are at or below it.

    Returns (digest, rows at or below it, all rows); the digest is ``""`` when
    even the first would exceed the target. ``target`` gets the row count.
    """
    digests = df.select(order.alias("digest"))
    prefix, before, wanted, total, best = "", 0, None, None, ""
    while True:
        width = len(prefix) + DIGITS_PER_STEP
        pool = digests.filter(F.col("digest").startswith(prefix)) if prefix else digests
        # At most 16 ** DIGITS_PER_STEP rows.
        groups = (
            pool.groupBy(F.substring("digest", 1, min(width, DIGEST_DIGITS)).alias("start"))
            .count()
            .collect()
        )
        groups = sorted((row["start"], row["count"]) for row in groups)
        if wanted is None:
            total = sum(n for _, n in groups)
            wanted = target(total)
        cut = None
        for start, n in groups:
            if before + n > wanted:
                cut = (start, n)
                break
            before += n
            best = start
        if cut is None or width >= DIGEST_DIGITS:
            # No group is cut: everything up to the last whole group is in.
            return (best and best.ljust(DIGEST_DIGITS, "g"), before, total)
        prefix, size = cut
        if size <= MAX_DRIVER_DIGESTS or width >= 2 * DIGITS_PER_STEP:
            inside = (
                digests.filter(F.col("digest").startswith(prefix))
                .groupBy("digest").count().limit(MAX_DRIVER_DIGESTS + 1).collect()
            )
            if len(inside) <= MAX_DRIVER_DIGESTS:
                best = best and best.ljust(DIGEST_DIGITS, "g")
                for value, n in sorted((row["digest"], row["count"]) for row in inside):
                    if before + n > wanted:
                        break
                    before += n
                    best = value
                return best, before, total


def split_cutoff(
    df: DataFrame,
    *,
    key: str = JOURNEY,
    fraction: float = TRAIN_FRACTION,
    seed: int = SEED,
    group_col: str | None = None,
) -> str:
    """The digest up to which rows are ``train``; see :func:`with_split`."""
    order = digest(group_col or key, seed)
    return digest_cutoff(df, order, lambda n: math.floor(fraction * n))[0]


def mark_split(
    df: DataFrame, cutoff: str, *, key: str = JOURNEY, seed: int = SEED, group_col: str | None = None
) -> DataFrame:
    """Add ``split`` for a known cutoff: each row tells its side by itself."""
    order = digest(group_col or key, seed)
    return df.withColumn("split", F.when(order <= cutoff, "train").otherwise("test"))


def with_split(
    df: DataFrame,
    *,
    key: str = JOURNEY,
    fraction: float = TRAIN_FRACTION,
    seed: int = SEED,
    group_col: str | None = None,
) -> DataFrame:
    """Add ``split``: exactly floor(fraction * n) rows are ``train``, the rest ``test``.

    ``key`` must identify a row. With ``group_col`` whole groups (say, all
    journeys of a patient) stay on one side, and train is as near to the size
    as whole groups in digest order allow without exceeding it.
    """
    cutoff = split_cutoff(df, key=key, fraction=fraction, seed=seed, group_col=group_col)
    return mark_split(df, cutoff, key=key, seed=seed, group_col=group_col)


def sample_cap(
    df: DataFrame, cap: int | None = None, *, key: str = JOURNEY, seed: int = SEED
) -> DataFrame:
    """Exactly ``cap`` random rows when there are more; else, and without a cap, all rows."""
    if cap is None:
        return df
    order = digest(key, f"{seed}:sample")
    cutoff, kept, total = digest_cutoff(df, order, lambda n: min(n, cap))
    return df if kept == total else df.filter(order <= cutoff)
