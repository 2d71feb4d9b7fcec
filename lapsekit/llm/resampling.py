"""Importance resampling towards a target: hashed n-gram weights and Gumbel noise.

Words and n-grams are Arrow kernels and array arithmetic: a batch is lowered,
split, flattened and dictionary-encoded once; n-grams are shifted dictionary
indices, only distinct ones are hashed, and gains are taken by bucket and
summed by segment. What is gathered is one count per bucket; the best rows are
numbered within ranges of the score, so nothing is sorted in one place.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lapsekit.llm.buffers import parts, tidy
from lapsekit.session import stage

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
#: Words a drawn document has at least, and the per cent of such documents that is drawn.
MIN_WORDS, SHARE = 20, 10
#: What separates words: ASCII characters other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def feature_buckets(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words per text; and for each n-gram length the text and bucket of every n-gram, texts ascending."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=BETWEEN)
    words = pc.dictionary_encode(pc.list_flatten(lists))
    ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = [w.encode("utf-8", "surrogatepass") for w in words.dictionary.to_pylist()]
    owner = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))
    if b"" in names:  # before a first and after a last separator
        kept = ids != names.index(b"")
        ids, owner = ids[kept], owner[kept]
    n_words = np.bincount(owner, minlength=len(texts))
    crcs = [zlib.crc32(name) for name in names]
    gram, grams = ids, []
    for n in range(1, longest + 1):
        if n > 1:
            same = owner[n - 1 :] == owner[: -(n - 1)]
            # An n-gram is its first n - 1 words and the word after them.
            pairs = gram[: len(ids) - n + 1] * len(names) + ids[n - 1 :]
            distinct, which = np.unique(pairs[same], return_inverse=True)
            crcs = [zlib.crc32(b" " + names[p % len(names)], crcs[p // len(names)]) for p in distinct.tolist()]
            gram = np.zeros(len(same), np.int64)
            gram[same] = which
            used, at = gram[same], owner[: len(same)][same]
        else:
            used, at = ids, owner
        bucket = np.array(crcs, np.int64) % buckets
        grams.append((at, bucket[used] if len(used) else np.zeros(0, np.int64)))
    return n_words, grams


def _histogram(longest: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in parts(batch, 0):
                for _, bucket in feature_buckets(part.column(0), longest, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return count


def bucket_counts(df: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: at most a row per task and bucket is shuffled, one per bucket collected."""
    counted = df.select(F.col(text).alias("text")).mapInArrow(tidy(_histogram(longest, buckets)), "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of every bucket, rounded down."""
    s_all, t_all, m = float(raw.sum()), float(target.sum()), float(len(raw))
    return np.array(
        [
            math.floor(1000 * math.log((float(t) + 1) * (s_all + m) / ((float(s) + 1) * (t_all + m))))
            for s, t in zip(raw.tolist(), target.tolist())
        ],
        np.int64,
    )


def _weights(gains: np.ndarray, longest: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                n_words, grams = feature_buckets(part.column(1), longest, len(gains))
                n, weight = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
                for at, bucket in grams:
                    own = np.bincount(at, minlength=len(n_words))
                    upto = np.concatenate([[0], np.cumsum(gains[bucket])])
                    ends = np.cumsum(own)
                    n += own
                    weight += upto[ends] - upto[ends - own]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words), pa.array(n), pa.array(weight)], names=["key", "n_words", "n_features", "weight"]
                )

    return weigh


def gumbel(key: Column, seed: int) -> Column:
    """Noise of a key in thousandths, rounded down; rows without a key have that of an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def with_ranks(rows: DataFrame, order: list[Column], drawn: int) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3, ... in the given order, null beyond ``drawn``.

    Rows are ranged and sorted within their range; a range's rows before it are a sum over the ranges.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = stage(placed, "ranged")
    part, number = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    # A row per range.
    before = placed.groupBy(part.alias("_part")).count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(before.drop("count")), "_part")
    rank = F.col("_before") + number + 1
    return ranked.withColumn("rank", F.when(rank <= drawn, rank)).select(*rows.columns, "rank")


def resample(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, share: int = SHARE,
) -> DataFrame:
    """One row per row of ``df``: key, n_features, weight, score, rank (null: not drawn).

    Features are the runs of 1 to ``longest`` words. Of the rows with
    ``min_words`` words or more, ``share`` per cent with the highest scores are
    drawn, ties to the smaller key, a null key last. Null and empty texts have
    no features and weight 0. Repeated rows count each and have a rank each.
    An empty table gives no row, an empty target a ratio as any other; other
    columns are left out.
    """
    gains = bucket_gains(bucket_counts(df, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    weighed = slim.mapInArrow(tidy(_weights(gains, longest)), f"key {kind}, n_words bigint, n_features bigint, weight bigint")
    scored = stage(weighed.withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)), "resampling")
    enough = F.col("n_words") >= min_words
    eligible = scored.filter(enough)
    drawn = share * eligible.count() // 100
    ranked = with_ranks(eligible, [F.col("score").desc(), F.col("key").asc_nulls_last()], drawn)
    every = ranked.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("bigint")))
    return every.select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
