"""Connected components of links between keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapsekit.session import stage


def components(links: DataFrame) -> DataFrame:
    """(v, label) of every key in ``links`` (a, b): the least key of its component.

    Each round takes the least label of the neighbours and then that label's
    own label, so rounds grow with the logarithm of a component's diameter.
    Labels are written between rounds; a hub is a row per neighbour on one
    side of a join only.
    """
    both = stage(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = stage(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("label")).select("v", F.least("v", "label").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("up"))
        after = stage(lower.join(up, "label").select("v", "old", F.least("label", "up").alias("label")), "labels")
        if after.filter("old <> label").isEmpty():
            return after.select("v", "label")
        labels = after.select("v", "label")
