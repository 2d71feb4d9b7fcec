"""The join that doesn't rely on adaptive skew handling."""

import random

import pytest
from pyspark.sql import functions as F

from lapsekit.operators.heavy_join import hot_keys, join_unique


@pytest.fixture
def one_file(spark, tmp_path):
    """A third of 120,000 lines in one order, all in one file of one row group."""
    lines = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, -7).otherwise(F.col("id")).alias("k"), F.col("id").alias("line"))
    lines.coalesce(1).write.option("parquet.block.size", str(1 << 30)).parquet(str(tmp_path / "lines"))
    orders = spark.range(-10, 120_000).select(F.col("id").alias("o"), (F.col("id") * 2).alias("v"))
    return spark.read.parquet(str(tmp_path / "lines")), orders


def test_no_task_gets_the_hot_order(spark, one_file):
    lines, orders = one_file
    assert hot_keys(lines, "k", least=1000) == [-7]
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.enabled": "false",
        "spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "32k",
    }
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = join_unique(lines, orders, "k", "o", least=1000)
        # The shuffled branch: rows of its tasks.
        shuffled = lines.filter(F.col("k") != -7).join(orders, F.col("k") == F.col("o"))
        sizes = sorted(r["count"] for r in shuffled.groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Union" in plan and plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1
        # The hot rows are joined in the task that read them: no exchange of theirs.
        hot_branch = plan.split("BroadcastHashJoin")[1]
        assert "Exchange hashpartitioning" not in hot_branch
        assert joined.count() == 120_000
        assert joined.agg(F.sum(F.col("v") - 2 * F.col("k"))).first()[0] == 0
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_same_rows_with_and_without_hot_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 2, 3, 4, 5, None, 99]), i) for i in range(5_000)]
    left = spark.createDataFrame(rows, "k int, n int")
    right = spark.createDataFrame([(k, f"v{k}") for k in (1, 2, 3, 4, 7)], "o int, v string")
    plain = sorted(map(tuple, left.join(right, F.col("k") == F.col("o")).collect()))
    assert sorted(map(tuple, join_unique(left, right, "k", "o", least=10, share=0.05).collect())) == plain
    assert sorted(map(tuple, join_unique(left, right, "k", "o").collect())) == plain
    assert hot_keys(left, "k") == [] and set(hot_keys(left, "k", least=10, share=0.2)) >= {1}
    assert join_unique(left.limit(0), right, "k", "o", least=-1).collect() == []
