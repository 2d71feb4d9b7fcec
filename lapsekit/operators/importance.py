"""Permutation importance of any score: exchange one feature's values, see how the error rises.

Rows get a global number by seeded digest. A feature's values are exchanged by
a bijection of those numbers of its own, a seeded shift, so no feature follows
another's exchange, no row keeps its place, and the exchange is over all rows,
however many there are and however they are partitioned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from lapsekit.operators.evaluate import SCORE
from lapsekit.operators.numbering import numbered
from lapsekit.operators.sampling import digest
from lapsekit.settings import JOURNEY, LABEL, SEED


def exchange_shift(name: str, rows: int, seed: int = SEED) -> int:
    """By how many places the values of a feature move: 1 to ``rows - 1``."""
    return 1 + int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:8], 16) % (rows - 1) if rows > 1 else 0


def _received(placed: DataFrame, names: Sequence[str], rows: int, seed: int) -> DataFrame:
    """(place, x0, x1, ...): for every row the exchanged value of each of ``names``.

    Every row sends each value to the row that takes it, so the exchange is one
    shuffle of narrow rows, evenly spread.
    """
    types = [placed.schema[name].dataType for name in names]
    number = all(isinstance(t, NumericType) for t in types)
    value = lambda name: F.col(name).cast("double" if number else "string")
    sent = F.array(
        *(
            F.struct(
                F.lit(i).alias("feature"),
                F.pmod(F.col("place") - exchange_shift(name, rows, seed), F.lit(rows)).alias("place"),
                value(name).alias("value"),
            )
            for i, name in enumerate(names)
        )
    )
    moved = placed.select(F.explode(sent).alias("sent")).select("sent.*")
    return moved.groupBy("place").agg(
        *(F.max(F.when(F.col("feature") == i, F.col("value"))).cast(t).alias(f"_x{i}") for i, t in enumerate(types))
    )


def permutation_importance(
    rows: DataFrame,
    names: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    *,
    label: str = LABEL,
    key: str = JOURNEY,
    seed: int = SEED,
) -> DataFrame:
    """(variable, importance): rise of the mean squared error of the score when ``names`` are exchanged one at a time.

    ``score`` adds ``predicted_probability`` to rows with the columns ``names``
    and keeps the other columns; it is called once, on one frame that holds
    every row as it is and once for each feature whose value changes. Rows
    without a label are left out. Keys should be unique; a null value is
    exchanged as any other; without rows every importance is zero.
    """
    names = list(names)
    wanted = rows.filter(F.col(label).isNotNull()).select(key, F.col(label).cast("double").alias("_y"), *names)
    placed = numbered(wanted, [digest(key, f"{seed}:exchange"), F.col(key)])
    n = placed.count()
    listed = F.array(*(F.lit(name) for name in names))
    variables = rows.sparkSession.range(len(names)).select(
        F.col("id").cast("int").alias("feature"), F.element_at(listed, F.col("id").cast("int") + 1).alias("variable")
    )
    if n < 2:
        return variables.select("variable", F.lit(0.0).alias("importance")).orderBy("variable")
    paired = placed.join(_received(placed, names, n, seed), "place").drop("place", key)
    differs = [~F.col(name).eqNullSafe(F.col(f"_x{i}")) for i, name in enumerate(names)]
    changed = F.array_compact(F.array(*(F.when(d, F.lit(i)) for i, d in enumerate(differs))))
    copies = paired.withColumn("_changed", changed).withColumn(
        "_feature", F.explode(F.concat(F.array(F.lit(-1)), F.col("_changed")))
    )
    exchanged = copies.withColumns(
        {name: F.when(F.col("_feature") == i, F.col(f"_x{i}")).otherwise(F.col(name)) for i, name in enumerate(names)}
    ).select("_y", "_feature", "_changed", *names)
    error = F.col("_y") - F.col(SCORE)
    scored = score(exchanged).select("_feature", "_changed", (error * error).alias("error"))

    # A copy adds its error to its feature; the row as it is takes its own error from each feature it has a copy for.
    def part(feature: Column, value: Column) -> Column:
        return F.struct(feature.alias("feature"), value.alias("value"))

    own = F.transform("_changed", lambda i: part(i, -F.col("error")))
    parts = F.when(F.col("_feature") < 0, own).otherwise(F.array(part(F.col("_feature"), F.col("error"))))
    sums = scored.select(F.explode(parts).alias("part")).groupBy(F.col("part.feature").alias("feature")).agg(
        F.sum("part.value").alias("rise")
    )
    # One row per feature.
    return (
        variables.join(sums, "feature", "left")
        .select("variable", F.coalesce(F.col("rise") / n, F.lit(0.0)).alias("importance"))
        .orderBy(F.desc("importance"), "variable")
    )
