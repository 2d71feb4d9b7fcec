"""Forests larger than the driver: trees are fitted, stored and scored in batches.

The driver holds one batch of trees at a time, so depth and number of trees are
bounded by the batch and not by each other. A row's score is the mean over all
trees, as that of one forest with all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapsekit.operators.evaluate import SCORE
from lapsekit.operators.forest import ForestSettings, fit_trees, load_forest, prepare_training, save_forest, score
from lapsekit.session import stage
from lapsekit.settings import FEATURES, JOURNEY, LABEL

#: Trees of a batch.
BATCH = 50
# Batches are told apart by their seeds.
_SEED_STEP = 7919


@dataclass(frozen=True)
class Ensemble:
    """Stored batches and how many trees each has."""

    path: str
    trees: tuple[int, ...]
    label: str

    def batch_path(self, i: int) -> str:
        return f"{self.path}/batch-{i:05d}"


def train_ensemble(
    train: DataFrame,
    path: str,
    features: Sequence[str] = FEATURES,
    *,
    label: str = LABEL,
    settings: ForestSettings = ForestSettings(),
    batch: int = BATCH,
    key: str = JOURNEY,
) -> Ensemble:
    """Fit ``settings.trees`` trees, ``batch`` at a time, and store them under ``path``.

    The batches follow from the rows, the seed and the batch size. What is
    stored last makes the ensemble readable, so a run that dies leaves none.
    """
    spark = train.sparkSession
    sizes = [min(batch, settings.trees - at) for at in range(0, settings.trees, batch)]
    ensemble = Ensemble(path, tuple(sizes), label)
    prepared = prepare_training(train, features, label, key)
    for i, size in enumerate(sizes):
        save_forest(fit_trees(prepared, replace(settings, trees=size, seed=settings.seed + _SEED_STEP * i)), ensemble.batch_path(i))
    known = spark.createDataFrame([(sizes, label)], "trees array<int>, label string")
    known.coalesce(1).write.mode("overwrite").parquet(f"{path}/ensemble")
    return ensemble


def load_ensemble(spark: SparkSession, path: str) -> Ensemble:
    known = spark.read.parquet(f"{path}/ensemble").first()
    return Ensemble(path, tuple(known["trees"]), known["label"])


def score_ensemble(ensemble: Ensemble, rows: DataFrame, *, key: str = JOURNEY) -> DataFrame:
    """``rows`` (unique ``key``) with the mean probability of a long gap over all trees.

    Each batch writes a number per row; what is shuffled is those numbers.
    """
    spark = rows.sparkSession
    parts = None
    for i, trees in enumerate(ensemble.trees):
        own = score(load_forest(spark, ensemble.batch_path(i)), rows).select(key, (F.col(SCORE) * trees).alias("_part"))
        own = stage(own, "batch-scores")
        parts = own if parts is None else parts.unionByName(own)
    mean = parts.groupBy(key).agg((F.sum("_part") / sum(ensemble.trees)).alias(SCORE))
    return rows.join(mean, key)
