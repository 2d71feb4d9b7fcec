"""The registered queries of this subpackage, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapsekit.llm import (
    exact_dedup,
    fill_in_middle,
    license_scan,
    mixing,
    near_dedup,
    packing,
    pii,
    quality,
    resampling,
    sharding,
    simhash,
    url_filter,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


def _on_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(documents(spark, folder))


def warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    resolved = warc.resolve_revisits(warc.records_of_pages(spark, folder))
    return resolved.withColumn("headers", warc.headers_text(F.col("headers"))).withColumnRenamed("at", "revisit_at")


def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    verdicts = url_filter.url_verdicts(url_filter.captures_of_pages(spark, folder), url_filter.entries_of_events(spark, folder))
    return verdicts.withColumnRenamed("at", "fetched_at")


def importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder.rstrip('/')}/benchmark.parquet")
    return resampling.resample(documents(spark, folder), benchmark)


REGISTRY: dict[str, Query] = {
    "op1_pii": _on_documents(pii.pii_digest),
    "op2_warc_revisits": warc_revisits,
    "op3_best_fit_packing": _on_documents(packing.pack_documents),
    "op4_vector_sharding": _on_documents(sharding.shard_documents),
    "op5_exact_dedup": _on_documents(exact_dedup.exact_duplicates),
    "op6_license_scan": _on_documents(license_scan.license_digest),
    "op7_mixing": _on_documents(mixing.mix),
    "op8_near_dedup": _on_documents(near_dedup.near_duplicate_classes),
    "op9_quality": _on_documents(quality.quality_scores),
    "op10_url_filter": url_verdicts,
    "op11_fill_in_middle": _on_documents(fill_in_middle.fill_in_middle_digest),
    "op12_simhash": _on_documents(simhash.simhash_digest),
    "op13_resampling": importance_resampling,
}


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
