"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as contract
from keysieve.plans import oracle, queries as plans

WITHOUT_SQL = set()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.registered()))
def test_query_equals_sql(spark, sf_dir, con, name):
    diff, got, expected = compare.differences(spark, con, sf_dir, name)
    assert not diff
    assert got > 0
    assert (expected is None) == (name in WITHOUT_SQL)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"repo", "severity", "findings"}


def test_sql_only_for_known_queries():
    assert set(oracle.statements()) == set(plans.registered()) - WITHOUT_SQL
    assert set(contract.oracle_sql()) <= set(contract.queries())
