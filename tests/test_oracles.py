"""Every registered query runs on the small tables and equals its DuckDB twin."""

import pytest
from check import compare, connect

from quarrywork.plans import load_all

QUERIES = load_all()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    ok, note = compare(name, spark, sf, duck)
    assert ok, note


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert not any(name == "pipeline" or name.startswith("op") and name[2:3].isdigit() for name in QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
