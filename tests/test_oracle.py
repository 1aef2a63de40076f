"""Every query with a SQL twin gives the same rows as DuckDB."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert differences(queries()[name](spark, FOLDER), duck, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
