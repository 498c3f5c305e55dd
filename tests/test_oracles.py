"""Every named query against DuckDB, and rows from those SQL cannot express."""

from __future__ import annotations

import pytest
from oracle import connect, differences

from chorus.catalog import REGISTRY


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_same_as_sql(spark, data, con, name):
    q = REGISTRY[name]
    assert differences(q.run(spark, data), con, q.sql) in (None, "both empty")


@pytest.mark.parametrize("name", ["model_roundtrip", "score_requests", "stream_score"])
def test_gives_rows(spark, data, name):
    assert REGISTRY[name].run(spark, data).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
