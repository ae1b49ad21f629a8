"""Every registered core query of the smallest tables against its SQL."""

import pytest

import oracle
from threadloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    if name in ORACLES:
        oracle.compare(spark, QUERIES[name], ORACLES[name], data)
    else:
        assert QUERIES[name](spark, data).count() >= 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
