"""Every registered query against its SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"
CHOSEN = sorted(q for q in oracle_sql() if not q.startswith("op"))


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_sql(spark, connection, name):
    assert differences(queries()[name](spark, SF), connection, oracle_sql()[name]) == []


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
