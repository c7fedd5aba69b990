import pytest

from tests.compare import assert_same
from tilework.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, queries.queries()[name], SQL[name])


def test_one_query_for_each_operator():
    assert [int(k[2:].split("_")[0]) for k in queries.queries()] == [*range(1, 14)]
