"""Every query with SQL gives the same rows as the SQL, over whole tables."""

import glob
import math
import os

import duckdb
import pytest

from topicloom import queries


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def check_rows(spark, sf, duck, name):
    found = queries.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    asked = duck.execute(queries.SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in asked.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(n for n, f in queries.QUERIES.items() if f.__module__ == queries.__name__))
def test_rows_equal_those_of_the_sql(spark, sf, duck, name):
    check_rows(spark, sf, duck, name)


def test_every_query_has_sql():
    assert set(queries.SQL) == set(queries.QUERIES)
