import pytest

import __spark_entry__ as entry
from quarry import catalog
from tests.oracle import connect, same

WITH_SQL = sorted(catalog.ORACLES)
WITHOUT = sorted(set(catalog.QUERIES) - set(catalog.ORACLES))


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_agrees_with_sql(spark, sf_dir, name):
    same(catalog.QUERIES[name](spark, sf_dir), connect(sf_dir).sql(catalog.ORACLES[name]))


@pytest.mark.parametrize("name", WITHOUT)
def test_query_runs_twice_alike(spark, sf_dir, name):
    first = sorted(map(repr, catalog.QUERIES[name](spark, sf_dir).collect()))
    assert first == sorted(map(repr, catalog.QUERIES[name](spark, sf_dir).collect()))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
