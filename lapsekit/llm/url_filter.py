"""Dated block and allow lists: what was listed when a URL was fetched.

Column expressions only. Edits of a list become validity intervals; a capture
asks for the interval of each of its keys (the URL, the directories above it,
the host and the domains above it) at its fetch time. Both steps look within
(key, bucket) and carry between buckets, so a hot host is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lapsekit.llm import urls
from lapsekit.llm.asof import last_state
from lapsekit.session import stage

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: Levels from general to specific; the most specific active entry decides, of one level the longest key.
LEVELS = ("domain", "prefix", "url")


def url_keys(url: Column) -> Column:
    """Array of (level, key) under which a list may name ``url``; none for a null or empty URL."""
    host = urls.host(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    first = F.greatest(n - 2, F.lit(0))
    domains = F.transform(F.sequence(F.lit(0), first), lambda i: F.array_join(F.slice(labels, i + 1, n), "."))
    parts = F.split(F.regexp_replace(urls.path(url), "[^/]*$", ""), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")),
    )
    named = lambda level, keys: F.transform(keys, lambda k: F.struct(F.lit(level).alias("level"), k.alias("key")))
    every = F.concat(
        named("domain", domains), named("prefix", F.array_distinct(prefixes)), named("url", F.array(urls.canonical(url)))
    )
    return F.when(F.coalesce(host, F.lit("")) != "", every)


def validity_intervals(entries: DataFrame, bucket: int = HOUR) -> DataFrame:
    """Edits (level, key, at, action, expires) as intervals (level, key, at, until, action), end exclusive.

    An interval ends with the next edit of its key or when it expires, else
    never (null). Of edits at one instant the greatest action holds, so
    ``remove`` beats ``block`` beats ``allow``. Edits without level, key, time
    or action are left out.
    """
    keys = ["level", "key"]
    edits = (
        entries.dropna(subset=[*keys, "at", "action"])
        .groupBy(*keys, "at").agg(F.max("action").alias("action"), F.min("expires").alias("expires"))
        .withColumn("_slot", F.floor(F.col("at") / bucket).cast("bigint"))
    )
    inner = edits.withColumn("_next", F.lead("at").over(Window.partitionBy(*keys, "_slot").orderBy("at")))
    later = (
        edits.groupBy(*keys, "_slot").agg(F.min("at").alias("_first"))
        .withColumn("_later", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_slot")))
        .select(*keys, "_slot", "_later")
    )
    until = F.least(F.coalesce("_next", "_later"), F.col("expires"))
    return inner.join(later, [*keys, "_slot"]).select(*keys, "at", until.alias("until"), "action")


def url_verdicts(captures: DataFrame, entries: DataFrame, bucket: int = HOUR) -> DataFrame:
    """One row per row of ``captures`` (page_id, url, at): verdict and the entry behind it.

    ``verdict`` is the action of the most specific entry active at the fetch
    time, ``none`` without one or for a null or empty URL or null time.
    Repeated captures stay repeated. Other columns of ``captures`` are left out.
    """
    rows = captures.select("page_id", "url", "at")
    asked = (
        rows.select("url", "at").dropna().distinct()
        .withColumn("_key", F.explode(url_keys(F.col("url")))).select("url", "at", "_key.level", "_key.key")
    )
    # Keys are worked out once: they are looked up and joined back.
    asked = stage(asked, "asked-keys")
    intervals = validity_intervals(entries, bucket).withColumn("entry", F.struct("action", F.col("at").alias("since"), "until"))
    at_fetch = last_state(asked, intervals, ["level", "key"], "at", "entry", bucket)
    active = at_fetch.filter(
        "entry IS NOT NULL AND (entry.until IS NULL OR at < entry.until) AND entry.action <> 'remove'"
    )
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    decided = asked.join(active, ["level", "key", "at"]).groupBy("url", "at").agg(
        F.max(F.struct(rank.alias("rank"), F.length("key").alias("n"), "key", "level", "entry")).alias("best")
    )
    return rows.join(decided, ["url", "at"], "left").select(
        "page_id", "url", "at",
        F.coalesce("best.entry.action", F.lit("none")).alias("verdict"),
        F.col("best.level").alias("level"), F.col("best.key").alias("key"),
        F.col("best.entry.since").alias("since"), F.col("best.entry.until").alias("until"),
    )


def captures_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page, fetched at a minute of the 30 days from 2024-01-01 that follows from its id."""
    return spark.read.parquet(f"{folder}/pages.parquet").select(
        "page_id", "url", (F.lit(1_704_067_200_000_000) + F.col("page_id") * 7919 % 43_200 * 60_000_000).alias("at")
    )


def entries_of_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a list edit on the page whose id is its user: type gives level and action."""
    what = F.col("event_type")
    url = F.col("url")
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("user_id").alias("page_id"), "event_type", at.alias("at")
    )
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    prefix = F.concat(urls.host(url), F.regexp_replace(urls.path(url), "[^/]*$", ""))
    return events.join(pages, "page_id").select(
        F.when(what == "signup", "url").when(what == "view", "prefix").otherwise("domain").alias("level"),
        F.when(what == "signup", urls.canonical(url)).when(what == "view", prefix).otherwise(urls.host(url)).alias("key"),
        "at",
        F.when(what == "error", "allow").when(what == "purchase", "remove").otherwise("block").alias("action"),
        F.when(what.isin("click", "view"), F.col("at") + 2 * DAY).alias("expires"),
    )
