"""Every registered query with a statement equals DuckDB's answer."""

import pytest
from compare import connect, difference

from oracle.statements import ORACLE
from twofold.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), duck, ORACLE[name]) is None


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
