"""Every query with a SQL twin gives the same names, types and values on the small test tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from tidecast.plans import catalog
from tests import oracle

QUERIES, SQL = catalog.QUERIES, catalog.ORACLE


@pytest.fixture(scope="session")
def tables(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, folder, tables, name):
    assert oracle.compare(spark, tables, folder, name, QUERIES[name], SQL[name]) is None


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"random_search", "guided_search", "guided_trials"}


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns[:2] == ["sys_created_date", "created_year"] and result.count() > 0


def test_driver_lists_the_catalogue():
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())
