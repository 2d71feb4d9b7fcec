"""Not-modified revisit records resolved to the response they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lapsekit.llm import urls
from lapsekit.llm.asof import last_state

#: Headers a 304 answer may replace in the stored ones. Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
HOUR = 3_600_000_000


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then coincide, the last one holds."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    pairs = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def _opaque(etag: Column) -> Column:
    """Weak comparison: the W/ mark doesn't count."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve_revisits(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """Every revisit record with the response it stands for and the merged headers.

    ``records``: record_id, warc_type, target_uri, at (bigint microseconds),
    status, headers (map), payload_digest; other columns are ignored. A full
    response is a ``response`` of status 200. A revisit looks up the latest
    one of its canonical URL strictly before it; at one instant the greatest
    record_id holds. The validators are then compared: entity tags if both have
    one, else payload digests, else Last-Modified. ``outcome``:

    * ``resolved``: equal; ``headers`` are the response's, with the permitted
      ones of the revisit laid over them;
    * ``changed``: unequal, so the response it repeats was never stored;
    * ``unverified``: no validator on both sides;
    * ``no_response``: no earlier full response, or a null URL or time.

    Only a resolved revisit has ``headers``. Repeated revisit records stay
    repeated; an empty table gives an empty one.
    """
    slim = records.select(
        "record_id", "warc_type", "at", "status", "payload_digest",
        urls.canonical(F.col("target_uri")).alias("canonical_url"), _lowered(F.col("headers")).alias("own"),
    )
    full = slim.filter("warc_type = 'response' AND status = 200").groupBy("canonical_url", "at").agg(
        F.max_by(F.struct("record_id", "at", "payload_digest", "own"), "record_id").alias("response")
    ).filter("response IS NOT NULL")
    revisits = slim.filter("warc_type = 'revisit'").drop("warc_type", "status")
    found = last_state(revisits, full, ["canonical_url"], "at", "response", HOUR, inclusive=False)
    joined = revisits.join(found, ["canonical_url", "at"], "left")

    def agreement() -> Column:
        mine, theirs = F.col("own"), F.col("response.own")
        both = (
            (_opaque(mine["etag"]), _opaque(theirs["etag"])),
            (F.col("payload_digest"), F.col("response.payload_digest")),
            (mine["last-modified"], theirs["last-modified"]),
        )
        return F.coalesce(*(a == b for a, b in both))

    laid_over = F.map_filter("own", lambda name, value: name.isin(*permitted))
    kept = F.map_filter(F.col("response.own"), lambda name, value: ~F.map_contains_key(laid_over, name))
    return (
        joined.withColumn("same", agreement())
        .withColumn(
            "outcome",
            F.when(F.col("response").isNull(), "no_response").when(F.col("same"), "resolved")
            .when(~F.col("same"), "changed").otherwise("unverified"),
        )
        .select(
            "record_id", "canonical_url", "at", "outcome",
            F.col("response.record_id").alias("response_id"), F.col("response.at").alias("response_at"),
            F.when(F.col("outcome") == "resolved", F.map_concat(kept, laid_over)).alias("headers"),
            F.when(F.col("outcome") == "resolved", F.col("response.payload_digest")).alias("payload_digest"),
        )
    )


def headers_text(headers: Column) -> Column:
    """One ``name: value`` a line, by name."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return F.array_join(F.array_sort(lines), "\n")


def records_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Crawl records of ``pages`` and ``events``.

    Every page has a full response within the 30 days from 2024-01-01 and a
    revisit ten days after it. An event is a later request for the page whose
    id is its user: a purchase stores a changed response, an error stores a
    failure, a signup a revisit without entity tag, anything else a revisit
    that quotes the page's tag as a weak one.
    """
    page = spark.read.parquet(f"{folder}/pages.parquet").select(
        "page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"),
        (F.lit(1_704_067_200_000_000) + F.col("page_id") * 7919 % 43_200 * 60_000_000).alias("stored"),
    )

    def headers(**values: Column) -> Column:
        return F.create_map(*(x for name, value in values.items() for x in (F.lit(name.replace("_", "-")), value)))

    def record(prefix: str, key: str, kind: Column, at: Column, status: Column, fields: Column, digest: Column) -> list[Column]:
        return [
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("record_id"), kind.alias("warc_type"),
            F.col("url").alias("target_uri"), at.alias("at"), status.alias("status"), fields.alias("headers"),
            digest.alias("payload_digest"),
        ]

    quoted = lambda tag: F.concat(F.lit('"'), tag, F.lit('"'))
    stored = F.col("stored")
    responses = page.select(
        record("p", "page_id", F.lit("response"), stored, F.lit(200), headers(
            ETag=quoted(F.col("digest")), Content_Type=F.lit("text/html"), Cache_Control=F.lit("max-age=60"),
            Date=stored.cast("string")), F.col("digest"))
    )
    again = stored + 240 * HOUR
    revisits = page.select(
        record("r", "page_id", F.lit("revisit"), again, F.lit(304), headers(
            etag=quoted(F.col("digest")), Cache_Control=F.lit("max-age=3600"), Date=again.cast("string"),
            Content_Type=F.lit("none")), F.lit(None).cast("string"))
    )
    event = spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", "event_type", F.col("user_id").alias("page_id"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("seen"),
    ).join(page.select("page_id", "url", "digest"), "page_id")
    what = F.col("event_type")
    changed = F.md5(F.concat(F.col("digest"), F.col("event_id").cast("string")))
    tag = F.when(what == "purchase", quoted(changed)).when(what != "signup", F.concat(F.lit("W/"), quoted(F.col("digest"))))
    own = F.map_filter(
        headers(ETag=tag, Date=F.col("seen").cast("string"), Expires=F.lit("0")), lambda name, value: value.isNotNull()
    )
    requests = event.select(
        record("e", "event_id", F.when(what.isin("purchase", "error"), "response").otherwise("revisit"), F.col("seen"),
               F.when(what == "purchase", 200).when(what == "error", 500).otherwise(304), own,
               F.when(what == "purchase", changed).when(what == "signup", F.col("digest")))
    )
    return responses.unionByName(revisits).unionByName(requests)
