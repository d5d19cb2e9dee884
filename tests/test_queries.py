"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import difference, duck

from tickloom.plans import ORACLES, QUERIES

# On the smallest tables no day has a return of all five symbols, so both sides are rightly empty.
EMPTY_ON_SMALLEST = {"returns_aligned"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_equals_sql(spark, sf, con, name):
    problem = difference(spark, con, QUERIES[name], ORACLES[name], sf)
    assert problem is None or (problem == "no rows" and name in EMPTY_ON_SMALLEST), problem


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 130
