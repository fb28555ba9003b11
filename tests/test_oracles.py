"""Every query with SQL against DuckDB on the smallest tables; every other query runs."""

import pytest

from evidentia.plans import compare, registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    assert not compare.differences(spark, registry.QUERIES[name], registry.ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() >= 0
