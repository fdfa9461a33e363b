"""Every registered query against its SQL in DuckDB."""

import pytest

from checks import registry
from checks.compare import database, spark_rows, sql_rows
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def db():
    return database(SMALL)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_agrees_with_sql(spark, db, name):
    names, got = spark_rows(registry.queries()[name](spark, SMALL))
    want_names, want = sql_rows(db, registry.oracle_sql()[name])
    assert names == want_names
    assert got == want


def test_every_query_has_sql():
    assert registry.queries().keys() == registry.oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query", "search_count"]
    assert __spark_entry__.queries().keys() >= registry.queries().keys()
