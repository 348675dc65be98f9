"""Every registered query with SQL against DuckDB on the smallest tables."""

import check
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    ok, note = check.compare(spark, duck, FOLDER, name)
    assert ok, note


def test_every_query_is_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
