import pytest

from loomspan.plans import registry

from .oracle import rows_of_query, rows_of_sql


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, sf_dir, name):
    got = rows_of_query(registry.queries()[name](spark, sf_dir))
    if name in registry.oracle_sql():
        want = rows_of_sql(registry.oracle_sql()[name], sf_dir)
        assert got[0] == want[0]
        assert got[1] == want[1]
    assert got[1]
