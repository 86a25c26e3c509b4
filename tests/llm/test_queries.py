"""The queries that SQL can express, against their SQL; and all of them over the smallest tables."""

import pytest

from arqueo.llm.queries import ORACLES, QUERIES
from tests.llm.cases import SF
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == []


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
