"""Queries with a statement equal DuckDB's answer over whole tables."""

import pytest
from compare import connect, difference

from twofold.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, small_dir, name):
    assert difference(QUERIES[name](spark, small_dir), connect(small_dir), ORACLE[name]) is None
