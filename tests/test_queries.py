"""Every query that has SQL agrees with it; the others run."""

import pytest
from oracle import database, same

from basalt.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(name, spark, sf_dir, con):
    same(catalog.queries()[name](spark, sf_dir), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_query_runs(name, spark, sf_dir):
    assert catalog.queries()[name](spark, sf_dir).columns


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
