import pytest

from postloom.plans.catalogue import QUERIES, SQL
from tests.oracle_check import compare, connect


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        compare(df, connect(small), SQL[name])
    else:
        assert df.count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
