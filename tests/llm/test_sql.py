"""Queries against their DuckDB SQL on the smallest tables."""

import pytest

from check_oracle import compare, duck_connection
from tidings.llm import queries


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_matches_duckdb(spark, sf_small, key):
    found = compare(spark, duck_connection(sf_small), sf_small, key)
    assert found["ok"], found
