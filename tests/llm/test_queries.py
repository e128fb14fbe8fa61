import pytest
from conftest import SF_ORACLE
from oracle import compare, duck

from trajframe.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(k for k, v in QUERIES.items() if v[1]))
def test_query_matches_sql(spark, name):
    r = compare(spark, duck(SF_ORACLE), *QUERIES[name], SF_ORACLE)
    assert r["cols_match"] and r["values_match"] and r["spark_rows"] == r["oracle_rows"] > 0, r


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
