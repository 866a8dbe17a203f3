"""Every query with a SQL statement, compared row by row at the smallest scale."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect


@pytest.fixture(scope="module")
def con(request):
    return connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert compare(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 6
