"""The operators' queries that SQL can express, against it."""

import pytest

from tessel.llm.queries import ORACLES, QUERIES
from tests.oracle import connection, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_oracle(spark, name):
    assert difference(QUERIES[name](spark, SF), connection(SF), ORACLES[name]) is None
