import pytest

from loomspan.llm import queries, twins
from tests.oracle import rows_of_query, rows_of_sql


@pytest.mark.parametrize("name", sorted(twins.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    got, want = rows_of_query(queries.queries()[name](spark, sf_dir)), rows_of_sql(twins.oracle_sql()[name], sf_dir)
    assert got[0] == want[0]
    assert got[1] == want[1] and got[1]
