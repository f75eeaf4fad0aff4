"""Every registered query against DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks import registry
from checks.compare import connect, difference


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    mine = registry.QUERIES[name](spark, sf).toPandas()
    oracle = registry.ORACLES.get(name)
    if oracle is None:
        assert len(mine)
    else:
        assert difference(mine, duck.execute(oracle).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 2
