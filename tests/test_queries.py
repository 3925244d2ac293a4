"""Every registered query runs, and gives what its SQL gives, on the smallest tables."""

import collections
import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, datetime.datetime) and value.tzinfo:
        return value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return value


def core_names():
    return sorted(n for n in entry.queries() if not n.startswith("p") or not n[1].isdigit() or n.startswith("p4_"))


@pytest.mark.parametrize("name", core_names())
def test_query(spark, tables, name):
    rows = entry.queries()[name](spark, FOLDER)
    found = rows.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    told = tables.sql(sql)
    columns = sorted(rows.columns)
    assert columns == sorted(told.columns)
    ours = collections.Counter(tuple(plain(r[c]) for c in columns) for r in found)
    place = [told.columns.index(c) for c in columns]
    theirs = collections.Counter(tuple(plain(r[k]) for k in place) for r in told.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
