"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as spark_entry
from assayer.plans import oracles, registry
from check_oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    con = connect(sf_dir)
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(registry.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name) is None


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
