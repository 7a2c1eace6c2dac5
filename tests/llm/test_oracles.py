import pytest
from oracle import same_rows

from rankloom.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_rows_equal_those_of_sql(spark, name):
    same_rows(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.001")
