import os

import pytest

from cairnspark.plans import oracle, registry

from oracle_compare import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_matches_sql(spark, name):
    compare(spark, SF, registry.QUERIES[name], oracle.ORACLES[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - oracle.ORACLES.keys()))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(oracle.ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
