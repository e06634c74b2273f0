from __future__ import annotations

import pytest

from stacklore.plans import oracle, queries
from tests.helpers import DATA, check_against_sql

pytestmark = pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="no test tables")
QUERIES, SQL = queries.queries(), oracle.sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    check_against_sql(spark, QUERIES[name], SQL[name], DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, str(DATA / "sf0.001")).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["source", "target", "weight", "support", "lift"]
