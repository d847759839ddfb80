"""Every registered query against its SQL at the smallest scale."""

import check_oracle
import pytest

import __spark_entry__ as entry_point

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(entry_point.oracle_sql()))
def test_query(spark, name):
    assert not check_oracle.run(spark, SMALL, [name])


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["query_id", "rank", "score", "vector_id", "path", "line"]


def test_sql_belongs_to_queries():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
