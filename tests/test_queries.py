"""Every query with SQL gives the same rows as its SQL; the others give rows of a stable schema."""

import __spark_entry__ as entry
import pytest

from tests.oracle import connect, rows_of

QUERIES = {name: f for m in entry.MODULES if not m.__name__.startswith("dossia.llm") for name, f in m.QUERIES.items()}
SQL = entry.oracle_sql()


# no key of the smallest tables has a value on both sides
EMPTY_IN_SMALL = {"num02_printed_precision"}


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_same_as_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    got = rows_of(df.columns, df.collect())
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows_of(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL))
def test_rows(spark, data, name):
    df = entry.queries()[name](spark, data)
    assert df.columns
    assert df.count() > 0 or name in EMPTY_IN_SMALL


def test_entry(spark):
    assert entry.entry(spark).count() > 0
