"""Keep the most frequent levels of categorical columns, lump the rest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lapsekit.session import stage
from lapsekit.settings import LUMP_LIMITS, OTHER_LEVEL

# A column with no more kept levels has them in the plan as literals. Of one with more (ties can keep very
# many) this many of the most frequent are literals, and the others are joined as a table.
MAX_LITERAL_LEVELS = 1_000
# Before any text that is a level: keys that start with it meet no level.
_NO_LEVEL = "\x00"


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per (variable, level) of all columns, in one pass; nulls left out."""
    texts = df.select(*(F.col(name).cast("string").alias(name) for name in columns))
    return (
        texts.unpivot([], columns, "variable", "level")
        .filter(F.col("level").isNotNull())
        .groupBy("variable", "level")
        .agg(F.count("*").alias("journeys"))
    )


def level_ranks(df: DataFrame, limits: Mapping[str, int] = LUMP_LIMITS) -> DataFrame:
    """Each level with its count, its rank (ties share the best) and whether it is kept.

    Ranks are computed per distinct count, not per level: a column of N rows has
    at most about sqrt(2N) distinct counts, so the window stays small even for a
    free-text column with a level per row.

    All levels within the limit are kept, with all levels tied at it. A single
    level beyond the limit is kept as well: renaming it would lump nothing.
    """
    counts = level_counts(df, list(limits))
    frequency = counts.groupBy("variable", "journeys").agg(F.count("*").alias("levels"))
    of_variable = Window.partitionBy("variable")
    above = of_variable.orderBy(F.desc("journeys")).rowsBetween(Window.unboundedPreceding, -1)
    limit = F.lit(0)
    for name, n in limits.items():
        limit = F.when(F.col("variable") == name, n).otherwise(limit)
    ranked = (
        frequency.withColumn("level_rank", 1 + F.coalesce(F.sum("levels").over(above), F.lit(0)))
        .withColumn("beyond", F.sum(F.when(F.col("level_rank") > limit, F.col("levels")).otherwise(0)).over(of_variable))
        .withColumn("kept", (F.col("level_rank") <= limit) | (F.col("beyond") <= 1))
        .select("variable", "journeys", "level_rank", "kept")
    )
    return counts.join(ranked, ["variable", "journeys"]).select(
        "variable", "level", "journeys", "level_rank", "kept"
    )


def lumped_levels(df: DataFrame, limits: Mapping[str, int] = LUMP_LIMITS) -> DataFrame:
    """The level table with the level each one is lumped to."""
    return level_ranks(df, limits).withColumn(
        "lumped_level", F.when(F.col("kept"), F.col("level")).otherwise(OTHER_LEVEL)
    )


@dataclass(frozen=True)
class Lumping:
    """Fitted kept levels; apply it to any frame with the same columns.

    ``levels`` holds literals of every column. A column named in ``joined`` has
    more levels, in ``table`` (variable, level, journeys).
    """

    variables: tuple[str, ...]
    levels: Mapping[str, tuple[str, ...]]
    joined: tuple[str, ...] = ()
    table: DataFrame | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        for name in self.variables:
            df = self._lump_joined(df, name) if name in self.joined else self._lump_literal(df, name)
        return df

    def _lump_literal(self, df: DataFrame, name: str) -> DataFrame:
        value = F.col(name).cast("string")
        kept = value.isin(list(self.levels.get(name, ())))
        return df.withColumn(name, F.when(value.isNull() | kept, value).otherwise(OTHER_LEVEL))

    def _lump_joined(self, df: DataFrame, name: str) -> DataFrame:
        """Only rows with a rarer value meet the table, each of which has few; the others are spread over all tasks."""
        value = F.col(name).cast("string")
        known = value.isNull() | value.isin(list(self.levels.get(name, ())))
        spread = F.concat(F.lit(_NO_LEVEL), F.monotonically_increasing_id().cast("string"))
        kept = self.table.filter(F.col("variable") == name).select(F.col("level").alias("_kept"))
        keyed = df.withColumn("_known", known).withColumn("_key", F.when(known, spread).otherwise(value))
        lumped = F.when(F.col("_known") | F.col("_kept").isNotNull(), value).otherwise(OTHER_LEVEL)
        return keyed.join(kept, F.col("_key") == F.col("_kept"), "left").withColumn(name, lumped).drop("_known", "_key", "_kept")


KEPT_LEVELS = "variable string, level string, journeys bigint"


def kept_table(lumping: Lumping, spark: SparkSession) -> DataFrame:
    """The kept levels as rows of ``KEPT_LEVELS``, to be stored with a model. Literals have no count: they come first."""
    rows = [(name, level, None) for name, levels in lumping.levels.items() for level in levels]
    literals = spark.createDataFrame(rows, KEPT_LEVELS)
    if lumping.table is None:
        return literals
    return literals.unionByName(lumping.table.join(literals.drop("journeys"), ["variable", "level"], "left_anti").select(literals.columns))


def lumping_of(
    kept: DataFrame, variables: Sequence[str] = tuple(LUMP_LIMITS), max_literals: int = MAX_LITERAL_LEVELS
) -> Lumping:
    """The lumping of stored kept levels (rows of ``KEPT_LEVELS``).

    The driver gets a count and at most ``max_literals`` level names per column.
    """
    sizes = {row["variable"]: row["count"] for row in kept.groupBy("variable").count().collect()}
    joined = tuple(name for name in variables if sizes.get(name, 0) > max_literals)
    small = [name for name in variables if name not in joined]
    found = kept.filter(F.col("variable").isin(small)).select("variable", "level").collect()
    for name in joined:
        frequent = kept.filter(F.col("variable") == name).orderBy(F.desc_nulls_first("journeys"), "level")
        found += frequent.select("variable", "level").limit(max_literals).collect()
    levels: dict[str, list[str]] = {}
    for row in found:
        levels.setdefault(row["variable"], []).append(row["level"])
    table = kept.filter(F.col("variable").isin(list(joined))) if joined else None
    return Lumping(tuple(variables), {name: tuple(sorted(v)) for name, v in levels.items()}, joined, table)


def fit_lumping(
    df: DataFrame, limits: Mapping[str, int] = LUMP_LIMITS, max_literals: int = MAX_LITERAL_LEVELS
) -> Lumping:
    """Find the levels to keep with one counting job, written once."""
    kept = level_ranks(df, limits).filter("kept").select("variable", "level", "journeys")
    return lumping_of(stage(kept, "kept-levels"), tuple(limits), max_literals)
