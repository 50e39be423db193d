"""Every registered query against its DuckDB oracle at sf0.01: names, row count, values."""

import pytest

from conftest import SF01
from oracle import compare, duck

from starweave.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    c = duck(SF01)
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert name in ORACLE
    n = compare(QUERIES[name](spark, SF01), con, ORACLE[name])
    assert n > 0
