"""Lookups of bounded size are sent to the tasks also where the session would shuffle them."""

from __future__ import annotations

import contextlib
import io

import pytest

from chorus.config import TfidfConfig
from chorus.operators import tfidf


@pytest.fixture()
def small_threshold(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, "one two three four " * (i % 3 + 1)) for i in range(30)], "id int, t string")


def plan(df) -> str:
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain()
    return said.getvalue()


def test_no_n_gram_is_shuffled_to_be_looked_up(spark, texts, small_threshold):
    config = TfidfConfig(min_df=1, max_df=1.0)
    vocab = tfidf.vocabulary(texts, "id", "t", config, ())
    weighed = plan(tfidf.weights(texts, "id", "t", vocab, config, ()))
    frequent = plan(tfidf._frequent_terms(texts, "id", "t", config, (), 2))
    for found in (weighed, frequent):
        assert "BroadcastHashJoin" in found and "SortMergeJoin" not in found


def test_bits_are_the_large_counters(spark):
    slots = [0, 1, 62, 63, 64, 127, 128, 4095, tfidf.SLOTS - 65, tfidf.SLOTS - 64, tfidf.SLOTS - 1]
    rows = spark.createDataFrame([(i,) for i in slots for _ in range(2)] + [(None,)], "_slot int")
    for large in (slots[::2], slots[1::2], [], slots):
        frame = spark.createDataFrame([(i,) for i in large], "_slot int")
        got = [r[0] for r in tfidf._in_large(rows, frame).collect()]
        assert sorted(got) == sorted([*large, *large])
