import pytest

from keystrand.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, small, same, name):
    same(queries.QUERIES[name](spark, small), queries.ORACLE[name])


def test_each_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
