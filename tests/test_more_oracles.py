"""The further core queries give the rows of their SQL, over whole tables."""

import pytest

from topicloom import more_queries, queries

from .test_oracles import check_rows, duck  # noqa: F401

NAMES = sorted(name for name, function in queries.QUERIES.items() if function.__module__ == more_queries.__name__)


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_those_of_the_sql(spark, sf, duck, name):  # noqa: F811
    check_rows(spark, sf, duck, name)


def test_every_query_has_sql():
    assert NAMES and set(queries.SQL) == set(queries.QUERIES)
