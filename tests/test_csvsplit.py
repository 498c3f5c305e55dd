"""Quoted CSV cut into splits gives the rows of a reader that sees whole files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from chorus.sources import csvsplit, tables
from chorus.workspace import shared_dir

COLUMNS = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()),
                        T.StructField("note", T.StringType())])


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes",
                                             "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_of_quoted_files(spark, small_splits):
    rng = random.Random(3)
    pieces = ['say "hi"', "line\nend", "a,b", "", None, '"', '""\n""', "long " * 300, "\n\n\n", "é \r\n x", "\\"]
    rows = [(i, rng.choice(pieces), rng.choice([*pieces, f"n{i}"])) for i in range(600)]
    path = shared_dir(spark, "quoted")
    tables.write_csv(spark.createDataFrame(rows, COLUMNS).coalesce(2), path)
    lines = csvsplit._lines(spark, path)
    assert lines.select("file", "split").distinct().count() > 20
    got = csvsplit.read_csv(spark, path, COLUMNS)
    want = tables.read_csv(spark, path, COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert got.count() == 600


def test_header_only_and_one_record(spark):
    path = shared_dir(spark, "few")
    tables.write_csv(spark.createDataFrame([(1, "a\nb", None)], COLUMNS).coalesce(1), path)
    assert [tuple(r) for r in csvsplit.read_csv(spark, path, COLUMNS).collect()] == [(1, "a\nb", None)]
    empty = shared_dir(spark, "empty")
    tables.write_csv(spark.createDataFrame([], COLUMNS).coalesce(1), empty)
    assert csvsplit.read_csv(spark, empty, COLUMNS).collect() == []
