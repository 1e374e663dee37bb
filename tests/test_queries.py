"""Every registered query against its check SQL on the smallest tables."""

import pytest
from checking import compare, connect

import __spark_entry__ as entry
from shelfline.plans import registry

QUERIES, CHECKS = registry.QUERIES, registry.CHECKS


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_check(spark, con, sf, name):
    assert name in CHECKS, "every query has a check"
    assert compare(spark, con, QUERIES[name], CHECKS[name], sf) is None


def test_entry_has_rows(spark):
    page = entry.entry(spark)
    assert page.columns[0] == "position" or "position" in page.columns
    assert page.count() > 0


def test_entry_offers_every_registered_query():
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())
