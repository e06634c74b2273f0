from __future__ import annotations

import pytest

from stacklore.llm import oracle, queries
from tests.helpers import DATA, check_against_sql

pytestmark = pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="no test tables")
QUERIES, SQL = queries.queries(), oracle.sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert check_against_sql(spark, QUERIES[name], SQL[name], DATA / ("sf0.01" if name.endswith("_found") else "sf0.001")) >= 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, str(DATA / "sf0.001")).count() > 0


COLUMNS = {
    1: ["src", "item_a", "item_b"], 2: ["src", "id", "term"], 3: ["field", "row_id_a", "row_id_b"], 4: ["row_id", "element"], 5: ["field", "value", "mark"],
    6: ["src", "id_a", "id_b"], 7: ["src", "id", "value", "canonical"], 8: ["doc_id"], 9: ["doc_id", "item_id"], 10: ["doc_id"],
}


@pytest.fixture(scope="module")
def no_rows(spark, tmp_path_factory):
    """The tables without rows, and with a column more whose name an operator uses itself."""
    folder = tmp_path_factory.mktemp("empty")
    for file in (DATA / "sf0.001").iterdir():
        table = spark.read.parquet(str(file)).limit(0)
        for name in ("id", "items", "rep", "src", "value", "n", "text"):
            if name not in table.columns:
                table = table.selectExpr("*", f"'x' AS {name}")
        table.write.parquet(str(folder / file.name))
    return str(folder)


@pytest.mark.parametrize("n", range(1, 11))
def test_columns_and_empty_tables(spark, no_rows, n):
    found = QUERIES[f"p{n}_found"](spark, no_rows)
    assert found.columns == COLUMNS[n]
    assert found.count() == 0
