"""As-of join that holds for hot keys: look back within a time bucket, else carry from earlier buckets.

An event of the right side is valid from its time until the next one of its
key. Both sides are first reduced to one row per (key, time), so a task never
sees more rows of a (key, bucket) than the bucket has ticks, and the carry of a
key never more rows than there are buckets. No pairs of rows are formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsekit.session import stage


def last_state(
    probes: DataFrame, events: DataFrame, keys: Sequence[str], time: str, state: str, bucket: int, inclusive: bool = True
) -> DataFrame:
    """One row per distinct (keys, time) of ``probes`` with ``state`` of the latest event at that time.

    ``time`` is a bigint. ``inclusive`` counts an event at the very time of the
    probe. ``events`` has one row per (keys, time) and a non-null ``state``;
    no event yet: null. Rows with a null key or time have no state.
    """
    keys = list(keys)
    known = lambda df: df.dropna(subset=[*keys, time])
    slot = lambda at: F.floor(at / bucket).cast("bigint")
    # An event sorts before the probe at the same time if it counts for it.
    points = known(probes).select(*keys, time).distinct().withColumn("_order", F.lit(1)).withColumn("_state", F.lit(None))
    changes = known(events).select(*keys, time, F.lit(0 if inclusive else 2).alias("_order"), F.col(state).alias("_state"))
    points = points.withColumn("_state", F.col("_state").cast(events.schema[state].dataType))
    # Both the look back and the carry start from it.
    line = stage(points.unionByName(changes).withColumn("_slot", slot(F.col(time))), "asof-line")

    def latest(within: Sequence[str], order: Sequence[str | Column], end: int) -> Column:
        return F.last("_state", ignorenulls=True).over(
            Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        )

    inner = line.withColumn("_near", latest([*keys, "_slot"], [time, "_order"], 0)).filter("_order = 1")
    # Per (key, bucket): what its last event leaves behind for later buckets.
    left = line.groupBy(*keys, "_slot").agg(
        F.max_by("_state", F.when(F.col("_state").isNotNull(), F.struct(time, "_order"))).alias("_state")
    )
    carry = left.withColumn("_carry", latest(keys, ["_slot"], -1)).select(*keys, "_slot", "_carry")
    return inner.join(carry, [*keys, "_slot"]).select(*keys, time, F.coalesce("_near", "_carry").alias(state))
