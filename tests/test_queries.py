"""Every named query next to its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from tidemark.plans import registry
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees(spark, db, folder, name):
    assert [d for d in differences(spark, db, name, folder) if d != "no rows"] == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
