"""Tables that several reports share, each written once."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lapsekit.operators.build import build_journeys
from lapsekit.operators.cohort import observed
from lapsekit.session import new_path
from lapsekit.sources.star_schema import STAR_OBSERVATION_END, TABLES, journey_inputs
from lapsekit.sources.tables import read_table

_paths: dict[tuple, str] = {}
_lock = threading.RLock()


def _path_and_fs(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def input_state(spark: SparkSession, folder: str) -> tuple:
    """Session, folder, and size and change time of its tables, to notice changes."""
    state = []
    for name in TABLES:
        path, fs = _path_and_fs(spark, f"{folder.rstrip('/')}/{name}.parquet")
        state.append((fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime()))
    return (spark.sparkContext.applicationId, folder, *state)


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of ``folder``; built and written if it is not there yet.

    One table per session and state of the inputs, in the folder the session
    names for such data. Reports read it as they would a table kept on a
    cluster: the work behind it runs once, each report scans its own columns,
    and a lost executor costs a re-read.
    """
    key = (*input_state(spark, folder), name)
    with _lock:
        path = _paths.get(key)
        if path is not None:
            hadoop_path, fs = _path_and_fs(spark, path)
            if not fs.exists(hadoop_path):
                path = None
        if path is None:
            path = new_path(spark, name)
            build().write.parquet(path)
            _paths[key] = path
    return read_table(spark, path)


def stored_journeys(spark: SparkSession, folder: str) -> DataFrame:
    """The observed-journey table of the star-schema tables in ``folder``.

    It holds the observation days as a column, so that eligibility is a filter
    the scan itself applies.
    """
    return stored(
        spark,
        folder,
        "journeys_observed",
        lambda: observed(build_journeys(journey_inputs(spark, folder)), STAR_OBSERVATION_END),
    )
