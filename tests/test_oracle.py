"""Every query with SQL gives the same rows as DuckDB, every other one rows."""

import pytest

from panelforge.plans import registry
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
SQL, QUERIES = registry.oracle_sql(), registry.queries()


LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    said = difference(spark, con, SF, QUERIES[name], SQL[name])
    # No rows prove nothing: thin cross-sections need the larger table.
    assert (difference(spark, connect(LARGER), LARGER, QUERIES[name], SQL[name]) if said == "no rows" else said) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    # Models need the larger table.
    assert QUERIES[name](spark, LARGER).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
