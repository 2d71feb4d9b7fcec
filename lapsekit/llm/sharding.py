"""Vector bin packing of documents into shards: bytes, tokens and rows are balanced together.

Equal texts are a group and share a shard, unless they are more than a whole
shard in some measure. Small groups are gathered in cells by hash, of a number
that depends on the shards alone; large ones are placed one by one. The driver
places these bounded many units, never the rows themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from lapsekit.llm.mixing import word_count
from lapsekit.session import stage

SHARDS = 24
#: Cells of a shard; and the share of a shard from which a group is a unit of its own, numbered in parts of that size.
CELLS, HEAVY = 256, 1 / 32
SIZE_EXTRA = 8
MEASURES = ("bytes", "tokens", "rows")


def place_units(weights: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every unit (row of ``weights``): heaviest first, where it agrees most with what room is left.

    Measures are scaled so that every shard has a room of 1 in each. Of the
    shards that the unit fits in (all if none), the one with the largest dot
    product of unit and residual room gets it; ties go to the lowest shard.
    """
    totals = weights.sum(axis=0)
    scaled = weights * shards / np.where(totals > 0, totals, 1)
    room = np.ones((shards, weights.shape[1]))
    out = np.zeros(len(weights), np.int64)
    for i in np.lexsort((np.arange(len(weights)), -scaled.max(axis=1, initial=0))):
        fits = (room >= scaled[i] - 1e-12).all(axis=1)
        score = room @ scaled[i]
        if fits.any():
            score = np.where(fits, score, -np.inf)
        out[i] = int(score.argmax())
        room[out[i]] -= scaled[i]
    return out


def shard_documents(
    df: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", cells: int = CELLS, heavy: float = HEAVY
) -> DataFrame:
    """One row per row of ``df``: key, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``. Equal texts share a shard unless they are more than
    a shard's share of all bytes, tokens or rows, when they are cut into parts
    of ``heavy`` of a shard. Slots number a shard's rows from 0. Null texts
    weigh 8 and are as empty ones; repeated rows and null keys get a slot each;
    an empty table gives no row. Other columns are left out.
    """
    spark = df.sparkSession
    own = F.coalesce(F.col(text), F.lit(""))
    rows = stage(
        df.select(
            F.col(key).alias("key"), (F.octet_length(own) + SIZE_EXTRA).cast("bigint").alias("size"),
            F.crc32(own).alias("text_crc32"), word_count(F.col(text)).alias("tokens"), F.xxhash64(own).alias("group"),
        ),
        "shard-rows",
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    totals = rows.agg(*sums).first()
    share = F.greatest(*(F.col(m) / F.lit(float(max(totals[m] or 0, 1)) * heavy / shards) for m in MEASURES))
    # In each measure at most shards / heavy groups can be that heavy.
    large = rows.groupBy("group").agg(*sums).select("group", share.alias("_share")).filter("_share > 1")
    # _parts: in which its rows are numbered side by side; _cut: its parts may go to different shards.
    large = stage(large.select("group", F.ceil("_share").cast("bigint").alias("_parts"), (F.col("_share") * heavy > 1).alias("_cut")), "heavy-groups")
    unit = F.when(F.col("_parts").isNull(), F.pmod("group", F.lit(cells * shards))).otherwise(F.col("group"))
    part = F.when(F.col("_parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.col("_parts")))
    units = rows.join(F.broadcast(large), "group", "left").withColumn("_unit", unit).withColumn("_part", part)
    weights = units.groupBy("_unit", "_part", "_cut").agg(*sums).orderBy("_unit", "_part").collect()
    together: dict[tuple, np.ndarray] = {}
    for w in weights:
        name = (w["_unit"], w["_part"] < 0, w["_part"] if w["_cut"] else None)
        together[name] = together.get(name, 0) + np.array([w[m] for m in MEASURES], float)
    shard = dict(zip(together, map(int, place_units(np.array(list(together.values())).reshape(len(together), len(MEASURES)), shards))))
    next_slot = [0] * shards
    plan = []
    for w in weights:
        s = shard[w["_unit"], w["_part"] < 0, w["_part"] if w["_cut"] else None]
        plan.append((w["_unit"], w["_part"], s, next_slot[s]))
        next_slot[s] += w["rows"]
    placed = units.join(F.broadcast(spark.createDataFrame(plan, "_unit bigint, _part bigint, shard int, _first bigint")), ["_unit", "_part"])
    number = F.row_number().over(Window.partitionBy("_unit", "_part").orderBy("key", "text_crc32", "size")) - 1
    return placed.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_first") + number).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
