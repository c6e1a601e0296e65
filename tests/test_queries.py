import pytest
from comparing import duck_rows, rows_of

from tokenloom.plans import queries as analytics


@pytest.mark.parametrize("name", sorted(analytics.queries()))
def test_query_matches_sql(spark, sf_dir, name):
    assert rows_of(analytics.queries()[name](spark, sf_dir)) == duck_rows(analytics.oracle_sql()[name], sf_dir)


def test_every_query_has_sql():
    assert set(analytics.queries()) == set(analytics.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
