"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "lapsekit") -> SparkSession:
    """A session for one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=None)
def _own_folder(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="lapsekit-")


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as the session names it.

    Only a single-machine session without that setting gets a folder of ours.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return _own_folder(spark.sparkContext.applicationId)
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lapsekit-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one intermediate table that no other table uses."""
    return f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard_staged(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session, when nothing reads them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    For frames that several jobs read: the work behind them runs once, a lost
    executor costs a re-read instead of a re-run, and every later job reads
    only the columns it needs.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
