"""Text queries: those with SQL give its rows, all of them give rows."""

import __spark_entry__ as entry
import pytest

from dossia.llm import queries as Q
from tests.oracle import connect, rows_of


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    rel = duck.sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in Q.QUERIES if n not in Q.SQL))
def test_rows(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0
