"""Every query with oracle SQL gives the oracle's whole result."""

import pytest
from oracle import compare, connect

from quillwork.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, sf, con, key):
    problems, rows, _ = compare(spark, con, QUERIES[key], ORACLES[key], sf)
    assert not problems, "\n".join(problems)
    assert rows > 0
