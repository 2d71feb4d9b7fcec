"""Mix sources to target weights: a budget per source becomes a threshold on a hash.

Column expressions only. Sizes are summed by source and hash bucket; the
threshold lies in one bucket of each source, and only that bucket is cut
further. Rows are then kept by comparing their hash, so nothing is sorted, and
a larger budget keeps what a smaller one did. The sums have at most
``2 ** BITS`` rows for a source; its rows themselves are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsekit.session import stage

#: Bits of the hash resolved by one histogram, and how many histograms: 48 bits in all.
BITS, LEVELS = 12, 4
#: A source may be repeated this often.
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Ranges in which the names of sources are put in order.
NAME_RANGES = 16


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters that aren't ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def row_hash(key: Column) -> Column:
    """48 bits of the MD5 of the key's text; a null key hashes as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("bigint")


def weighted_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with ``target``: weights 1, 2, 3, ... by name, capped, the excess reshared.

    Names are ranked in ranges, then by offsets of the ranges. Resharing by
    weight ends when no source is above its cap; each round is one sum over
    the sources and brings two numbers to the driver.
    """
    ranged = stage(
        sizes.repartitionByRange(NAME_RANGES, F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()),
        "mix-sources",
    )
    before = ranged.groupBy("_range").count().withColumn(
        "_before", F.sum("count").over(Window.orderBy("_range")) - F.col("count")
    )
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = stage(
        ranged.join(F.broadcast(before.drop("count")), "_range").withColumn("_weight", weight)
        .select("source", "source_size", "_weight"),
        "mix-weights",
    )
    cap = F.col("source_size") * MAX_REPEATS
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while True:
        free = cap >= F.col("_weight") * F.lit(share)
        fixed, weights, n = weighed.agg(
            F.sum(F.when(~free, cap)), F.sum(F.when(free, F.col("_weight"))), F.count(F.when(~free, 1))
        ).first()
        if n == capped or not weights:
            break
        share, capped = (total - (fixed or 0)) / weights, n
    target = F.least((F.col("_weight") * F.lit(share)).cast("double"), cap.cast("double"))
    return weighed.select("source", "source_size", target.alias("target"))


def hash_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): rows of a source with a hash below it sum to its ``budget``, as near as a row allows.

    ``rows``: source, size, hash (48 bits); ``budgets``: source, budget, each
    source once. Rows of one hash are kept or left together.
    """
    left = rows.select("source", "size", "hash")
    state = budgets.select(F.col("source").alias("_s"), F.col("budget").cast("double").alias("_rest"))
    for level in range(LEVELS):
        width = 1 << BITS * (LEVELS - 1 - level)
        bucket = F.expr(f"hash div {width}")
        sums = left.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_size"))
        upto = F.sum("_size").over(Window.partitionBy("source").orderBy("_bucket"))
        # The bucket in which the budget ends, and what is left of it there.
        edge = (
            sums.withColumn("_upto", upto)
            .join(state, F.col("source").eqNullSafe(F.col("_s")))
            .filter("_upto > _rest")
            .groupBy(F.col("source").alias("_e"))
            .agg(F.min(F.struct("_bucket", (F.col("_rest") - F.col("_upto") + F.col("_size")).alias("rest"), "_size")).alias("e"))
        )
        known = state.join(edge, F.col("_s").eqNullSafe(F.col("_e")), "left")
        state = stage(known.select("_s", "e._bucket", F.col("e.rest").alias("_rest"), "e._size"), "mix-edges")
        inside = state.filter("_bucket IS NOT NULL").select(F.col("_s").alias("_i"), "_bucket")
        if level < LEVELS - 1:
            at_edge = F.col("source").eqNullSafe(F.col("_i")) & (bucket == F.col("_bucket"))
            left = stage(left.join(inside, at_edge, "left_semi"), "mix-boundary")
            # A source without such a bucket keeps all its rows; it has no boundary further on.
            done = state.filter("_bucket IS NULL").select("_s")
            whole = done if level == 0 else whole.unionByName(done)
            state = state.filter("_bucket IS NOT NULL").select("_s", "_rest")
    nearer = F.when(F.col("_rest") * 2 >= F.col("_size"), 1).otherwise(0)
    limit = F.coalesce(F.col("_bucket") + nearer, F.lit(1 << BITS * LEVELS))
    return state.select(F.col("_s").alias("source"), limit.alias("threshold")).unionByName(
        whole.select(F.col("_s").alias("source"), F.lit(1 << BITS * LEVELS).alias("threshold"))
    )


def mix_plan(rows: DataFrame) -> DataFrame:
    """Per source of ``rows`` (source, size, hash): source_size, target, whole copies and the threshold for one more."""
    targets = stage(weighted_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    limits = hash_thresholds(rows, targets.select("source", (F.col("target") - whole * F.col("source_size")).alias("budget")))
    limits = limits.withColumnRenamed("source", "_s")
    return stage(
        targets.join(limits, F.col("source").eqNullSafe(F.col("_s"))).select(
            F.col("source").alias("_source"), "source_size", "target", "threshold", whole.alias("whole")
        ),
        "mix-plan",
    )


def _narrow(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    return stage(
        df.select(
            F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            row_hash(F.col(key)).alias("hash"),
        ),
        "mix-rows",
    )


def _copies(hashed: Column) -> Column:
    return F.col("whole") + F.when(hashed < F.col("threshold"), 1).otherwise(0)


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Every row's ``key`` with size, source_size, target and ``taken`` words.

    A source takes whole copies of all its rows as far as its target goes, and
    one more copy of the rows whose hash is below its threshold. Rows without
    a key hash alike. Null text has size 0; a null source is a source; an empty
    table gives no row. Other columns are left out.
    """
    rows = _narrow(df, key, source, text)
    plan = mix_plan(rows)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * _copies(F.col("hash"))).alias("taken")
    )


def repeat_rows(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, its columns unchanged."""
    plan = mix_plan(_narrow(df, key, source, text)).select(
        *(F.col(name).alias(f"_mix_{name}") for name in ("_source", "whole", "threshold"))
    )
    extra = F.when(row_hash(F.col(key)) < F.col("_mix_threshold"), 1).otherwise(0)
    copies = (F.col("_mix_whole") + extra).cast("int")
    joined = df.join(plan, F.col(source).eqNullSafe(F.col("_mix__source")))
    return joined.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*df.columns)
