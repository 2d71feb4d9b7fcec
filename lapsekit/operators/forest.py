"""Random forest on the model frame: train, score, importance.

The forest is MLlib's. It differs from single-machine forests in known ways,
so results agree statistically and not tree by tree: depth is at most 30;
``min_node_size`` binds each child and not the node that is split; categorical
levels are split as unordered sets; and out-of-bag rows are not kept, so
permutation importance is taken on held-out rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from lapsekit.operators import importance
from lapsekit.operators.evaluate import SCORE
from lapsekit.session import stage
from lapsekit.settings import FEATURES, JOURNEY, LABEL, LUMP_LIMITS, SEED

# Training rows are dealt to this many tasks at least, and to one more for each further number of rows.
# Both are fixed, so that the forest follows from its rows and its seed, whatever cluster fits it.
LEAST_PARTITIONS, ROWS_PER_PARTITION = 16, 250_000
# A task that scores unpacks all trees first, so it gets this many rows at least; the most bounds what a lost task costs.
LEAST_SCORED, MOST_SCORED = 1_000, 50_000
# A checkpoint of the node ids (a number per training row and tree) is only worth its writing when very many passes follow.
PASSES_PER_CHECKPOINT = 100


@dataclass(frozen=True)
class ForestSettings:
    """The driver holds the trees, about trees * 2 ** max_depth nodes at most; see ``operators.ensemble`` for more."""

    trees: int = 500
    max_depth: int = 10
    min_node_size: int = 25
    seed: int = SEED


@dataclass(frozen=True)
class Forest:
    """Fitted stages: level indexer (if any categorical feature), assembler, trees."""

    model: PipelineModel
    features: tuple[str, ...]
    label: str

    def inputs(self) -> list[str]:
        """The numeric columns the trees see, in the order of ``features``."""
        return [_indexed(name) for name in self.features]


def _indexed(name: str) -> str:
    return f"{name}_index" if name in LUMP_LIMITS else name


@dataclass(frozen=True)
class Training:
    """Training rows as label and feature vector, dealt to tasks, and the stages that make them."""

    stages: tuple
    rows: DataFrame
    features: tuple[str, ...]
    label: str
    most_levels: int


def prepare_training(
    train: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL, key: str = JOURNEY
) -> Training:
    """What any number of fits start from; the label is 0/1, so class index and label value agree.

    Bootstrap draws follow the partitions and the order within them, so both
    are set here from the rows alone: their number decides the number of
    partitions, their key the partition and the order. Levels unseen in
    training get an index of their own.
    """
    count = train.agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if (count["lo"], count["hi"]) != (0, 1):
        raise ValueError(f"{label} must hold both 0 and 1 in the training rows")
    partitions = max(LEAST_PARTITIONS, -(-count["n"] // ROWS_PER_PARTITION))
    # Dealt again after the table is read: how files are cut into tasks depends on the cluster.
    stored = stage(train.select(key, label, *features), "train")
    placed = stored.repartition(partitions, key).sortWithinPartitions(key)
    categorical = [name for name in features if name in LUMP_LIMITS]
    stages: list = []
    most_levels = 0
    if categorical:
        indexer: StringIndexerModel = StringIndexer(
            inputCols=categorical,
            outputCols=[_indexed(name) for name in categorical],
            handleInvalid="keep",
            stringOrderType="frequencyDesc",
        ).fit(stored)
        stages.append(indexer)
        most_levels = max(len(levels) for levels in indexer.labelsArray) + 1
    stages.append(VectorAssembler(inputCols=[_indexed(name) for name in features], outputCol="features"))
    rows = PipelineModel(stages).transform(placed).select(F.col(label).cast("double").alias("label"), "features")
    return Training(tuple(stages), rows, tuple(features), label, most_levels)


def fit_trees(training: Training, settings: ForestSettings = ForestSettings()) -> Forest:
    trees = RandomForestClassifier(
        numTrees=settings.trees,
        maxDepth=settings.max_depth,
        minInstancesPerNode=settings.min_node_size,
        featureSubsetStrategy=str(max(1, math.floor(math.sqrt(len(training.features))))),
        maxBins=max(32, training.most_levels),
        cacheNodeIds=True,
        checkpointInterval=PASSES_PER_CHECKPOINT,
        maxMemoryInMB=512,
        seed=settings.seed,
    ).fit(training.rows)
    return Forest(PipelineModel([*training.stages, trees]), training.features, training.label)


def train_forest(
    train: DataFrame,
    features: Sequence[str] = FEATURES,
    *,
    label: str = LABEL,
    settings: ForestSettings = ForestSettings(),
    key: str = JOURNEY,
) -> Forest:
    """Fit the forest. The same rows and seed give the same forest on any session."""
    return fit_trees(prepare_training(train, features, label, key), settings)


def scoring_tasks(rows: int, slots: int) -> int:
    """Rounds in which every slot has a task of at most ``MOST_SCORED`` rows; fewer tasks if there are few rows."""
    rounds = -(-rows // (MOST_SCORED * slots))
    return max(1, min(rounds * slots, -(-rows // LEAST_SCORED)))


def dealt_evenly(rows: DataFrame) -> DataFrame:
    """``rows``, which should be a stored table, in equal shares for ``score``.

    A stored table is small for what its rows cost to score, so its files make few
    and unequal tasks. The shares are by place: neither a key nor the files count.
    """
    return rows.repartition(scoring_tasks(rows.count(), rows.sparkSession.sparkContext.defaultParallelism))


def score(forest: Forest, rows: DataFrame) -> DataFrame:
    """``rows`` with the probability of a long gap."""
    scored = forest.model.transform(rows).withColumn(SCORE, vector_to_array("probability")[1])
    return scored.select(*rows.columns, SCORE)


def gini_importance(forest: Forest, spark: SparkSession) -> DataFrame:
    """Split-gain importance of the fitted trees: a different measure, seen on training rows."""
    gains = forest.model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame(
        [(name, float(gain)) for name, gain in zip(forest.features, gains)], "variable string, importance double"
    )


def permutation_importance(forest: Forest, rows: DataFrame, *, key: str = JOURNEY, seed: int = SEED) -> DataFrame:
    """Rise of the squared error of the score when a feature's values are exchanged; see ``operators.importance``.

    Levels are indexed before the exchange, so a copy costs the trees alone.
    Features the trees never split on are zero without being scored.
    """
    gains = forest.model.stages[-1].featureImportances.toArray()
    used = {column: name for column, name, gain in zip(forest.inputs(), forest.features, gains) if gain > 0}
    one = rows.sparkSession.range(1)
    unused = F.array(*(F.lit(name) for name in forest.features if name not in used.values())).cast("array<string>")
    zero = one.select(F.explode(unused).alias("variable"), F.lit(0.0).alias("importance"))
    if not used:
        return zero.orderBy("variable")
    assembler, trees = forest.model.stages[-2:]
    prepared = rows.select(key, forest.label, *forest.features)
    for fitted in forest.model.stages[:-2]:
        prepared = fitted.transform(prepared)
    idle = [column for column in forest.inputs() if column not in used]

    def score(df: DataFrame) -> DataFrame:
        # What the trees never look at may be anything.
        whole = df.withColumns({column: F.lit(0.0) for column in idle}) if idle else df
        scored = trees.transform(assembler.transform(whole)).withColumn(SCORE, vector_to_array("probability")[1])
        return scored.select(*df.columns, SCORE)

    found = importance.permutation_importance(prepared, list(used), score, label=forest.label, key=key, seed=seed)
    # One row per feature.
    pairs = F.array(*(F.struct(F.lit(column).alias("column"), F.lit(name).alias("name")) for column, name in used.items()))
    names = one.select(F.explode(pairs).alias("pair")).select("pair.*")
    named = found.join(F.broadcast(names), F.col("variable") == F.col("column")).select(F.col("name").alias("variable"), "importance")
    return named.unionByName(zero).orderBy(F.desc("importance"), "variable")


def save_forest(forest: Forest, path: str) -> None:
    """Stages under ``model``; the features in their order and the label under ``inputs``."""
    forest.model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    inputs = spark.createDataFrame([(list(forest.features), forest.label)], "features array<string>, label string")
    inputs.coalesce(1).write.mode("overwrite").parquet(f"{path}/inputs")


def load_forest(spark: SparkSession, path: str) -> Forest:
    inputs = spark.read.parquet(f"{path}/inputs").first()
    return Forest(PipelineModel.load(f"{path}/model"), tuple(inputs["features"]), inputs["label"])
