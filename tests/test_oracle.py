"""Every registered query with an oracle SQL matches DuckDB at sf0.01
(row count, column names, multiset of values)."""

import pytest

from conftest import SF_ORACLE
from oracle import compare, duck
from trajframe.plans.catalog import load_all

QUERIES = load_all()
WITH_SQL = sorted(k for k, v in QUERIES.items() if v[1] is not None)


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_oracle(spark, con, name):
    fn, sql = QUERIES[name]
    r = compare(spark, con, fn, sql, SF_ORACLE)
    assert r["cols_match"], r
    assert r["spark_rows"] == r["oracle_rows"] > 0, r
    assert r["values_match"], r
