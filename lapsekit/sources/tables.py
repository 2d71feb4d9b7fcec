"""Stored tables: write, replace, read, query with SQL.

A table that is replaced while others read it is kept in versions: each one is
a folder of its own, and a numbered marker names it once it is whole. Markers
are created, never changed, so a reader sees one version or the next, two
writers can't both make the same one, and a writer that dies leaves the table
as it was. No file system operation is needed but exclusive creation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_MARKERS = "_versions"


class _Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._root = self._path(path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        path = self._jvm.org.apache.hadoop.fs.Path(parts[0])
        for part in parts[1:]:
            path = self._jvm.org.apache.hadoop.fs.Path(path, part)
        return path

    def names(self, *parts: str) -> list[str]:
        path = self._path(self._root.toString(), *parts)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def read(self, *parts: str) -> str:
        stream = self._fs.open(self._path(self._root.toString(), *parts))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, text: str, *parts: str) -> bool:
        """Whether the file could be created; False if it is there already."""
        path = self._path(self._root.toString(), *parts)
        if self._fs.exists(path):
            return False
        try:
            stream = self._fs.create(path, False)
        except Exception:
            if self._fs.exists(path):  # another writer was first
                return False
            raise
        try:
            self._jvm.org.apache.commons.io.IOUtils.write(text, stream, "UTF-8")
        finally:
            stream.close()
        return True

    def delete(self, *parts: str) -> None:
        self._fs.delete(self._path(self._root.toString(), *parts), True)


def _versions(folder: _Folder) -> list[tuple[int, str]]:
    """(number, folder) of the whole versions, oldest first. A marker that was not written to its end names none."""
    found = []
    for name in folder.names(_MARKERS):
        if name.isdigit():
            text = folder.read(_MARKERS, name)
            if text.endswith("\n"):
                found.append((int(name), text.strip()))
    return sorted(found)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Create or overwrite the table at ``path``, which nobody else reads, and return it as read back."""
    df.write.mode("overwrite").parquet(path)
    return read_table(df.sparkSession, path)


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Make ``df`` the current version of the table at ``path`` and return it as read back.

    ``df`` may read the table itself. Frames read before stay on their version.
    """
    spark = df.sparkSession
    folder = _Folder(spark, path)
    version = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{version}")
    while True:
        known = [int(name) for name in folder.names(_MARKERS) if name.isdigit()]
        number = max(known, default=0) + 1
        if folder.create(f"{version}\n", _MARKERS, f"{number:09d}"):
            return spark.read.parquet(f"{path.rstrip('/')}/{version}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table in versions, or the table itself."""
    versions = _versions(_Folder(spark, path))
    return spark.read.parquet(f"{path.rstrip('/')}/{versions[-1][1]}" if versions else path)


def remove_old_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the last ``keep`` versions, and what unfinished writers left; how many folders went.

    For times when no older version is read and nobody replaces the table.
    """
    folder = _Folder(spark, path)
    versions = _versions(folder)
    kept = {name for _, name in versions[-keep:]}
    for number, name in versions[:-keep]:
        folder.delete(_MARKERS, f"{number:09d}")
    old = [name for name in folder.names() if name.startswith("version-") and name not in kept]
    for name in old:
        folder.delete(name)
    return len(old)


def sql_report(journeys: DataFrame, query: str) -> DataFrame:
    """Run a SQL text that names the journey table as ``{journeys}``."""
    return journeys.sparkSession.sql(query, journeys=journeys)
