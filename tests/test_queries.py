"""Every registered core query runs; those with SQL give its rows."""

import pytest

from tesserine.plans import registry
from tests.oracle import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = rows_of(registry.QUERIES[name](spark, sf))
    if name in registry.SQL:
        assert got == rows_of_sql(duck, registry.SQL[name])


def test_entry(spark, sf, monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "SMOKE", sf)
    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
