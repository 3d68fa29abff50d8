import pytest

from keystrand.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_matches_sql(spark, small, same, name):
    same(catalogue.QUERIES[name](spark, small), catalogue.ORACLE[name])


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)


def test_entry_runs_without_the_other_subpackage(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1500
    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_replacement_selection_makes_fewer_runs(spark, small):
    assert catalogue.run_comparison(spark, small).first().fewer
