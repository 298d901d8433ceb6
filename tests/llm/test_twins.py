"""The text queries that have a DuckDB twin, on the smallest tables; and that all queries have rows there."""

import pytest
from compare import differences, duck

from furrow.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    assert not differences(QUERIES[name](spark, SF), duck(SF), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
