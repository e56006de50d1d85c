"""Every registered query of the library against its SQL."""

import pytest
from sql_match import assert_same, connection

from vicinage.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), catalog.SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    """tests/test_operators.py compares these with plain versions."""
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "other_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
