"""The registered queries: shape of the entry points, and every oracle at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check_oracles import connect, rows
from conftest import SF
from sensitext.plans import catalog


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "type", "findings", "distinct_values"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    assert len(set(got.columns)) == len(got.columns)
    if name in catalog.ORACLES:
        assert rows(got.toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())
    else:
        got.collect()
