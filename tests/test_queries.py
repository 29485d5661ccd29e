"""Every registered query at the smallest scale, next to its SQL."""

import pytest

import __spark_entry__ as entry
from conftest import SMALL
from tools.compare import compare, connect


@pytest.fixture(scope="module")
def database():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, database, name):
    ok, note, _ = compare(spark, database, SMALL, name)
    assert ok, note


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "term", "weight"]
