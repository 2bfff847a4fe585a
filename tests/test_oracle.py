"""Every query that has SQL, against DuckDB over the smallest tables."""

import math

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def shape(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    wanted = duck.sql(entry.oracle_sql()[name])
    got, want = shape(found.columns, found.collect()), shape(wanted.columns, wanted.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert got == want


def test_blended_entropy_by_day_reads_every_event(spark):
    rows = entry.queries()["blended_entropy_by_day"](spark, SF).collect()
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_type is not null")
    assert sum(r["n"] for r in rows) == events.count() and {r["user_id"] for r in rows} == {r["user_id"] for r in events.select("user_id").distinct().collect()}
    assert any(r["n"] < 10 for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
