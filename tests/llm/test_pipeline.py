from __future__ import annotations

import pytest
import corpus_pipeline
from test_lines import brute as brute_lines
from test_packing import check
from test_simhash import brute_components, brute_fingerprint

from chorus.llm import mixing


@pytest.fixture(scope="module")
def stages(spark, data):
    from chorus.workspace import stage

    docs, seen = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, fn in corpus_pipeline.STAGES:
        out = stage(fn(spark, docs, data), "test-stage")
        seen.append((name, docs, out))
        docs = out
    return seen


def test_columns_pass_until_the_last_stage(stages):
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_language_stage_keeps_documents_with_words(stages):
    _, before, after = stages[0]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    texts = {r.doc_id: r.text or "" for r in before.collect()}
    assert len(gone) <= 0.05 * len(texts)
    assert all(len(texts[i]) > 400 or not any(c.isalpha() for c in texts[i]) for i in gone)


def test_line_stage_like_brute_force(stages):
    _, before, after = stages[1]
    want = brute_lines((r.doc_id, r.text) for r in before.collect())
    assert {r.doc_id: r.text for r in after.collect()} == {i: t for i, t in want.items()
                                                           if t and t.strip(" \t\n\x0b\f\r")}
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_duplicate_stage_like_brute_force(stages):
    _, before, after = stages[2]
    fps = {r.doc_id: brute_fingerprint(r.text) for r in before.collect()}
    label = brute_components(sorted(set(fps.values())))
    want = {}
    for i, f in sorted(fps.items()):
        want.setdefault(label[f], i)
    assert sorted(r.doc_id for r in after.collect()) == sorted(want.values())


def test_mixture_stage_follows_the_rates(stages, spark, data):
    _, before, after = stages[3]
    rates = mixing.mix(before, spark.read.parquet(f"{data}/labels.parquet"), corpus_pipeline.MIXTURE)
    want = {r.doc_id: r.copies for r in rates.collect() if r.copies}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == want


def test_packing_stage_holds_every_document(stages):
    _, before, after = stages[4]
    texts = {r.doc_id: r.text for r in before.collect()}
    once = after.dropDuplicates(["doc_id", "piece"]).collect()
    assert {r.doc_id for r in once} == set(texts)
    if before.count() == len(texts):
        check(after.collect(), texts)


def test_run_is_the_stages_in_a_row(stages, spark, data):
    _, _, after = stages[4]
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).select(*keys).collect())) == sorted(
        map(tuple, after.select(*keys).collect()))


def test_empty_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, fn in corpus_pipeline.STAGES:
        docs = fn(spark, docs, data)
        assert docs.count() == 0
