"""Every operator query against its SQL, and that it gives all rows."""

from __future__ import annotations

import pytest
from oracle import connect, differences

from chorus.llm import catalog


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, data, con, name):
    assert differences(catalog.QUERIES[name](spark, data), con, catalog.SQL[name]) is None


@pytest.mark.parametrize("name", ["op1_mix_sources", "op6_token_counts", "op8_licence_scan",
                                  "op9_language_id"])
def test_one_row_per_document(spark, data, name):
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    assert catalog.QUERIES[name](spark, data).count() == n


def test_entry_has_the_operators():
    import __spark_entry__ as entry
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names}
    assert "pipeline" in names
