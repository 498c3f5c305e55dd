"""Physical plans: what is pushed down, and what must not appear."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chorus.catalog import REGISTRY
from chorus.functions import text as tx
from chorus.operators import tfidf
from chorus.operators.rows import unfold
from chorus.sources.tables import load

NAMES = ["ingest_dedup", "clean_stats", "class_distribution", "crosstab", "keyword_freq_by_class",
         "category_tagging", "confusion_matrix", "roc_auc", "top_terms_by_class", "stratified_split",
         "lexicon_sentiment", "ngram_language_id", "tfidf_weights", "unseen_items", "histogram",
         "label_encode", "dq_duplicates", "posts_with_labels", "quota_prefix", "surrogate_key"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_pairs_and_no_row_functions(spark, data, name):
    text = plan(REGISTRY[name].run(spark, data))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert word not in text


def test_filter_and_columns_reach_the_scan(spark, data):
    text = plan(REGISTRY["export_posts"].run(spark, data))
    assert "EqualTo(source,src1)" in text and "n_chars" not in text


def test_entities_are_decoded_once(spark, data):
    text = plan(REGISTRY["clean_stage"].run(spark, data))
    assert "Python" not in text
    assert text.count("https?://") == 1 and text.count("utf-32") + text.count("UTF-32") >= 1


def test_tokens_are_not_computed_in_a_filter(spark, data):
    docs = load(spark, data, "documents")
    text = plan(unfold(docs, tx.tokens(F.col("text")), "word", "doc_id"))
    assert text.count("regexp_extract_all") == 1


def test_terms_are_counted_without_a_second_shuffle(spark, data):
    counts = tfidf.terms(load(spark, data, "documents"), "doc_id", "text").groupBy(
        "doc_id", "term").count()
    assert plan(counts).count("Exchange") == 1


def test_staged_lookups_are_broadcast_by_size_only(spark, data):
    df = load(spark, data, "documents")
    vocab = tfidf.vocabulary(df, "doc_id", "text")
    assert "BroadcastHashJoin" in plan(tfidf.weights(df, "doc_id", "text", vocab))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(tfidf.weights(df, "doc_id", "text", vocab))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
