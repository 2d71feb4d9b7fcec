import glob
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lapsekit import session
from lapsekit.plans import store
from lapsekit.sources.csv_reports import read_report, write_report, write_rows
from lapsekit.sources import tables
from lapsekit.sources.tables import read_table, remove_old_versions, replace_table, write_table

ROWS = [("a", 0.0005, 1, True), (None, 1e8, None, False), ("", None, 3, None), ('x, "y"', 0.1, 4, True)]
SCHEMA = "name string, value double, n int, flag boolean"


def test_csv_round_trip_keeps_nulls_empty_text_and_digits(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = str(tmp_path / "report")
    write_report(df, path)
    files = glob.glob(path + "/part-*.csv")
    assert len(files) == 1
    text = open(files[0]).read().splitlines()
    assert text[0] == "name,value,n,flag"
    assert text[1] == "a,0.0005,1,TRUE"
    assert text[2] == "NA,100000000,NA,FALSE"
    back = sorted(map(tuple, read_report(spark, path, SCHEMA).collect()), key=str)
    assert back == sorted(ROWS, key=str)


def test_the_missing_marker_itself_reads_as_missing(spark, tmp_path):
    write_report(spark.createDataFrame([("NA",)], "name string"), str(tmp_path / "r"))
    assert read_report(spark, str(tmp_path / "r"), "name string").first()["name"] is None


def test_rows_are_written_by_partition_value(spark, tmp_path):
    write_rows(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "rows"), "n")
    assert glob.glob(str(tmp_path / "rows" / "n=4" / "*.csv"))


def test_write_table_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(5).toDF("x"), path)
    assert write_table(spark.range(3).toDF("x"), path).count() == 3


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "t")
    first = replace_table(spark.range(5).toDF("x"), path)
    assert read_table(spark, path).count() == 5
    second = replace_table(read_table(spark, path).filter("x > 2"), path)  # made from the table itself
    assert (first.count(), second.count(), read_table(spark, path).count()) == (5, 2, 2)
    assert remove_old_versions(spark, path) == 1
    assert read_table(spark, path).count() == 2


def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    replace_table(spark.range(5).toDF("x"), path)
    # While rows are written.
    with pytest.raises(Exception):
        replace_table(spark.range(9).selectExpr("IF(id = 7, raise_error('lost'), id) AS x"), path)
    assert read_table(spark, path).count() == 5
    # Between the rows and their marker.
    monkeypatch.setattr(tables._Folder, "create", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        replace_table(spark.range(9).toDF("x"), path)
    monkeypatch.undo()
    assert read_table(spark, path).count() == 5
    # A marker that was not written to its end.
    (tmp_path / "t" / "_versions" / "000000002").write_text("version-of-no")
    assert read_table(spark, path).count() == 5
    assert replace_table(spark.range(3).toDF("x"), path).count() == 3
    assert read_table(spark, path).count() == 3
    assert remove_old_versions(spark, path) >= 2 and read_table(spark, path).count() == 3


def test_writers_at_one_time_make_a_version_each(spark, tmp_path):
    path = str(tmp_path / "t")
    sizes = list(range(1, 7))
    with ThreadPoolExecutor(6) as pool:
        frames = list(pool.map(lambda n: replace_table(spark.range(n).toDF("x"), path), sizes))
    assert [f.count() for f in frames] == sizes
    assert len(list((tmp_path / "t" / "_versions").glob("0*"))) == 6
    assert read_table(spark, path).count() in sizes


def test_a_report_beyond_one_file_stays_in_order(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("(id * 7919) % 20000 AS n", "IF(id % 7 = 0, NULL, id / 8) AS v").orderBy(F.desc("n"))
    path = str(tmp_path / "r")
    assert write_report(rows, path, rows_per_file=3_000) == 20_000
    files = sorted(glob.glob(path + "/part-*.csv"))
    lines = [open(f).read().splitlines()[1:] for f in files]
    assert len(files) == 7 and max(map(len, lines)) < 2 * 20_000 / 7
    assert [int(line.split(",")[0]) for own in lines for line in own] == list(range(19_999, -1, -1))


def test_rows_and_reports_have_one_text_form(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    write_report(df, str(tmp_path / "report"))
    write_rows(df, str(tmp_path / "rows"))
    text = lambda name: sorted(line for f in glob.glob(str(tmp_path / name / "part-*.csv")) for line in open(f).read().splitlines()[1:])
    assert text("report") == text("rows")


def test_staged_frame_is_read_back_from_the_shared_folder(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    staged = session.stage(spark.range(10).toDF("x"), "numbers")
    assert staged.count() == 10
    assert all(f.startswith(f"file://{tmp_path}") for f in staged.inputFiles())
    session.discard_staged(spark)
    assert list(tmp_path.iterdir()) == []


def test_the_session_names_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert session.shared_folder(spark)
    if named:
        assert session.shared_folder(spark) == named.rstrip("/")


def test_changed_inputs_are_noticed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "TABLES", ("t",))
    folder = str(tmp_path)
    read = lambda: spark.read.parquet(f"{folder}/t.parquet")
    built = []

    def build():
        built.append(1)
        return read()

    for rows in (5, 5, 8):
        if len(built) < 1 or rows == 8:
            spark.range(rows).toDF("x").write.mode("overwrite").parquet(f"{folder}/t.parquet")
        assert store.stored(spark, folder, "copy", build).count() == rows
    assert len(built) == 2
