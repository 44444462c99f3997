import pytest

from tidemark.plans.registry import ORACLES, QUERIES

from .oracle import same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert same_rows(spark, QUERIES[name], ORACLES[name]) > 0
