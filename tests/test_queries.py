"""Every registered query against its SQL on the smallest data set.

Queries of the optional package may have none; tests/llm holds them to brute force.
"""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare
from tests.conftest import SF_SMALL
from tidings.plans.catalog import QUERIES


def test_names():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_its_sql(spark, name):
    verdict, _ = compare(spark, SF_SMALL, name, queries()[name], oracle_sql().get(name))
    assert verdict.startswith("ok" if name in oracle_sql() else "rows only"), verdict
