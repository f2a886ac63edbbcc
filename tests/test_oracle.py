"""Every query of the library against its SQL in DuckDB."""

import pytest

from tallyframe.plans import catalog

from .compare import SF, database, rows


@pytest.fixture(scope="module")
def duck():
    return database()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(found.columns) and len(found)
        return
    expected = duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
