"""The as-of operators against plain SQL and brute force."""

import random

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from lapsekit.llm import check_sql, url_filter, warc
from lapsekit.llm.asof import last_state

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(check_sql.statements()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "events", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    ours, theirs = contract.queries()[name](spark, FOLDER), con.sql(contract.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    left = [tuple(r[c] for c in columns) for r in ours.collect()]
    right = [tuple(r[theirs.columns.index(c)] for c in columns) for r in theirs.fetchall()]
    assert sorted(map(repr, left)) == sorted(map(repr, right)) and left


@pytest.mark.parametrize("inclusive", [True, False])
def test_last_state(spark, inclusive):
    rng = random.Random(3)
    events = {(rng.choice("abc"), rng.randrange(200)): i for i in range(60)}
    probes = [(rng.choice("abcd"), rng.randrange(200)) for _ in range(200)] + [(None, 1), ("a", None)]
    out = last_state(
        spark.createDataFrame(probes, "k string, at bigint"),
        spark.createDataFrame([(k, t, s) for (k, t), s in events.items()], "k string, at bigint, s int"),
        ["k"], "at", "s", 16, inclusive,
    ).collect()
    assert {(r["k"], r["at"]) for r in out} == {p for p in probes if None not in p}
    for r in out:
        before = [(t, s) for (k, t), s in events.items() if k == r["k"] and (t <= r["at"] if inclusive else t < r["at"])]
        assert r["s"] == (max(before)[1] if before else None)


def test_revisits(spark):
    schema = "record_id string, warc_type string, target_uri string, at bigint, status int, headers map<string,string>, payload_digest string, canonical_url string"
    url = "HTTP://A.example:80/x/?utm_source=1&b=2&a=1#top"
    rows = [
        ("p1", "response", url, 10, 200, {"ETag": '"1"', "Server": "s", "Date": "d1"}, "x", "clash"),
        ("p2", "response", url, 20, 500, {"ETag": '"2"'}, "y", None),
        ("r1", "revisit", "a.example/x?a=1&b=2", 30, 304, {"etag": 'W/"1"', "DATE": "d2", "Server": "no"}, None, None),
        ("r1", "revisit", "a.example/x?a=1&b=2", 30, 304, {"etag": 'W/"1"', "DATE": "d2", "Server": "no"}, None, None),
        ("r2", "revisit", url, 10, 304, None, "x", None),
        ("r3", "revisit", url, 40, 304, {"etag": '"3"'}, "x", None),
        ("r4", "revisit", url, 40, 304, None, None, None),
        ("r5", "revisit", None, None, None, None, None, None),
    ]
    out = warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()
    got = {r["record_id"]: r["outcome"] for r in out}
    assert got == {"r1": "resolved", "r2": "no_response", "r3": "changed", "r4": "unverified", "r5": "no_response"}
    assert len(out) == 6
    assert next(r for r in out if r["record_id"] == "r1")["headers"] == {"etag": 'W/"1"', "server": "s", "date": "d2"}
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_url_verdicts(spark):
    captures = [(1, "http://b.a.com/x/y", 5), (2, "http://b.a.com/x/y", 15), (2, "http://b.a.com/x/y", 15), (3, None, 15), (4, "", 1), (5, "http://a.com/q", None), (6, "http://b.a.com/x/y", 26), (7, "http://b.a.com/z", 25)]
    entries = [
        ("domain", "a.com", 10, "block", None), ("domain", "a.com", 20, "remove", None),
        ("prefix", "b.a.com/x/", 12, "allow", 14), ("prefix", "b.a.com/x/", 25, "block", None), ("url", None, 1, "block", None),
    ]
    out = url_filter.url_verdicts(
        spark.createDataFrame(captures, "page_id int, url string, at bigint"),
        spark.createDataFrame(entries, "level string, key string, at bigint, action string, expires bigint"), 8,
    ).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in out) == [
        (1, "none"), (2, "block"), (2, "block"), (3, "none"), (4, "none"), (5, "none"), (6, "block"), (7, "none")
    ]
    none = spark.createDataFrame([], "page_id int, url string, at bigint")
    assert url_filter.url_verdicts(none, spark.createDataFrame(entries, "level string, key string, at bigint, action string, expires bigint")).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, FOLDER)
        assert out.schema.names == docs.schema.names
        assert function(spark, docs.limit(0), FOLDER).count() == 0
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(packed.columns)
