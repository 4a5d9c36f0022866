from __future__ import annotations

import pytest

import __spark_entry__ as contract
import oracle
from tidalframe.plans import registry, training_queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connection(sf_dir)


@pytest.mark.parametrize("name", registry.SQL)
def test_query_equals_its_sql(name, spark, sf_dir, con):
    assert not oracle.differences(registry.QUERIES[name](spark, sf_dir), con, registry.SQL[name])


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


def test_every_core_query_has_sql():
    assert set(registry.QUERIES) - set(registry.SQL) == {"pca_components", "projected_points", "k_sweep", "auto_k", *training_queries.COMPOSED}
    assert set(contract.oracle_sql()) <= set(contract.queries())
