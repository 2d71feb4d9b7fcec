"""Every registered query against plain SQL over the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from lapsekit.plans import check_sql
from lapsekit.plans import queries as registered

ROOT = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()
SCALES = os.environ.get("CHECK_SCALES", "sf0.01").split(",")
QUERIES = registered.queries()
SQL = check_sql.statements()

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")

# Column types that hold the same values in both engines.
SAME_TYPE = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module", params=SCALES)
def folder(request):
    return f"{ROOT}/{request.param}"


@pytest.fixture(scope="module")
def db(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _sortable(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) - set(registered.WITHOUT_SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, folder, name):
    ours = QUERIES[name](spark, folder)
    theirs = db.sql(SQL[name])
    types = dict(zip(theirs.columns, map(str, theirs.types)))
    assert {c: SAME_TYPE[t] for c, t in ours.dtypes} == types
    columns = sorted(ours.columns)
    left = sorted((tuple(r[c] for c in columns) for r in ours.collect()), key=_sortable)
    at = [theirs.columns.index(c) for c in columns]
    right = sorted((tuple(r[i] for i in at) for r in theirs.fetchall()), key=_sortable)
    assert len(left) == len(right)
    assert left or folder.endswith("sf0.001"), "no rows"
    for a, b in zip(left, right):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float) and math.isnan(x):
                assert math.isnan(y)
            else:
                assert x == y, (a, b)


def test_contract_lists_every_query():
    assert set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 5
    assert sum(r["journeys"] for r in rows) == 216
