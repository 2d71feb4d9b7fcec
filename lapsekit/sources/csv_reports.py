"""Tables as CSV: header, ``NA`` for missing, ``TRUE``, numbers without exponents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from lapsekit.functions.labels import plain_number
from lapsekit.session import stage

MISSING = "NA"
# Rows of a file. A report with no more is a single file.
ROWS_PER_FILE = 500_000


def _as_text(field: StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, DoubleType):
        value = plain_number(value)
    elif isinstance(field.dataType, BooleanType):
        value = F.upper(value.cast("string"))
    return value.alias(field.name)


def _writer(df: DataFrame):
    """All tables are written in this one text form."""
    texts = df.select(*map(_as_text, df.schema.fields))
    return texts.write.mode("overwrite").option("header", True).option("nullValue", MISSING).option("emptyValue", '""')


def write_report(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Replace the CSV at ``path`` by the rows of ``df`` in their order; how many there are.

    The rows are counted before they are gathered: up to ``rows_per_file`` make
    one file, more are dealt to files by their place, so that the files one
    after the other, by name, hold the rows in order and no task more than its
    share. As in other CSV with such a marker, the text ``NA`` reads back as missing.
    """
    # The ids ascend along the frame's own order; the stored table may be read in any.
    placed = stage(df.withColumn("_place", F.monotonically_increasing_id()), "report")
    rows = placed.count()
    files = max(1, -(-rows // rows_per_file))
    dealt = placed.coalesce(1) if files == 1 else placed.repartitionByRange(files, "_place")
    _writer(dealt.sortWithinPartitions("_place").drop("_place")).csv(path)
    return rows


def write_rows(df: DataFrame, path: str, *partition_by: str) -> None:
    """Replace the CSV at ``path`` by rows of any number in no order, one file per task and partition value."""
    writer = _writer(df)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def read_report(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read a CSV report; the schema is declared, not guessed from the text."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", MISSING)
        .option("emptyValue", "")
        .csv(path)
    )
