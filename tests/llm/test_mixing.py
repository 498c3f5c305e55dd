from __future__ import annotations

import warnings

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus.llm import mixing


@pytest.fixture(scope="module")
def tables(spark, data):
    return (spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))


def solve(p, t, target):
    """Plain projected gradient in numpy on all rows, to convergence."""
    rates, scale = np.ones(len(p)), t.sum()
    norm = np.linalg.inv((p * t[:, None]).T @ p / scale + 1e-9 * np.eye(p.shape[1]))
    for _ in range(20_000):
        rates = np.maximum(0, rates - p @ (norm @ (((t * rates) @ p - target) / scale)))
    return rates


def test_expected_tokens_match_the_targets(tables):
    docs, labels = tables
    weights = {"good": 0.7, "poor": 0.2, "toxic": 0.1}
    rows = mixing.mix(docs, labels, weights, total=200_000.0).collect()
    p = np.array([[r.p_good, r.p_poor, r.p_toxic] for r in rows])
    t = np.array([r.n_tokens for r in rows], float)
    rates = np.array([r.rate for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (rates >= 0).all()
    got = (rates * t) @ p
    assert np.allclose(got, [140_000, 40_000, 20_000], rtol=1e-3)
    plain = solve(p, t, np.array([140_000, 40_000, 20_000]))
    assert np.allclose((plain * t) @ p, got, rtol=1e-3)
    assert all(abs(r.copies - r.rate) < 1 for r in rows)


def test_classifier_on_rows_it_has_not_seen(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = mixing.fit(docs, labels.filter(fold != 0))
    truth = {r.doc_id: r.domain for r in
             labels.filter(fold == 0).select("doc_id", mixing.domain_of().alias("domain")).collect()}
    rows = mixing.posteriors(docs, model).filter(fold == 0).collect()
    hits = [mixing.DOMAINS[int(np.argmax(r.p))] == truth[r.doc_id] for r in rows if r.doc_id in truth]
    assert np.mean(hits) >= 0.9
    toxic = [r.p[2] for r in rows if truth.get(r.doc_id) == "toxic"]
    clean = [r.p[2] for r in rows if truth.get(r.doc_id) == "good"]
    assert np.mean(np.array(toxic) > 0.5) >= 0.75 and np.mean(np.array(clean) < 0.5) >= 0.97


def test_toxic_rates_fall_to_zero_and_good_ones_stay(tables):
    docs, labels = tables
    rows = mixing.mix(docs, labels, {"good": 0.93, "poor": 0.055, "toxic": 0.015}).collect()
    assert all(r.rate < 0.2 for r in rows if r.p_toxic > 0.9)
    assert all(r.rate >= 0.98 for r in rows if r.p_good > 0.95)


def test_rows_follow_their_copies(tables, clashing):
    docs, labels = (x for x in tables)
    docs = clashing(docs)
    weights = {"good": 0.6, "poor": 0.4}
    want = {r.doc_id: r.copies for r in mixing.mix(docs, labels, weights).collect() if r.copies}
    out = mixing.mixed_documents(docs, labels, weights)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want


def test_awkward_texts_and_labels(frame, awkward, clashing, spark):
    docs = clashing(frame(awkward + ["good words here"] * 10 + ["bad idiot words"] * 10))
    n = len(awkward)
    labels = spark.createDataFrame(
        [(i, 1, int(i >= n + 10)) for i in range(n, n + 20)] + [(None, 1, 0), (n, 0, 0), (9999, 1, 1),
                                                                 (n + 1, None, None)],
        "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs, labels, {"good": 1.0}).collect()
    assert len(rows) == n + 20 and all(r.rate >= 0 for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id == 0] == [0]


def test_no_labels_and_no_rows(frame, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = mixing.mix(frame(["a b", None], [None, 3]), labels, {"good": 1.0}).collect()
    assert all(abs(r.rate - 1) < 1e-6 and r.copies >= 0 for r in rows)
    assert mixing.mix(frame([]), labels, {"good": 1.0}).count() == 0
    assert mixing.mixed_documents(frame([]), labels, {"good": 1.0}).count() == 0


def posterior_rows(poor, toxic, sharp, n=6000):
    """Tokens and posteriors of a made corpus, and its classes."""
    rng = np.random.default_rng(8)
    y = rng.choice(3, n, p=[1 - poor - toxic, poor, toxic])
    z = rng.standard_normal((n, 3))
    z[np.arange(n), y] += sharp
    return mixing.softmax(z), rng.integers(5, 2000, n).astype(float), y


@pytest.mark.parametrize("poor,toxic,sharp", [(0.3, 0.12, 5), (0.6, 0.3, 5), (0.45, 0.2, 2),
                                              (0.6, 0.3, 2)])
def test_rates_are_optimal_on_poor_and_toxic_corpora(spark, poor, toxic, sharp):
    p, t, _ = posterior_rows(poor, toxic, sharp)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p)],
                                 "tokens long, p array<double>").repartition(3)
    weights = {"good": 0.93, "poor": 0.055, "toxic": 0.015}
    rates = mixing.replay(p, mixing.fit_rates(rows, weights))
    have, scale = t @ p, t.sum()
    target = np.array([weights[x] for x in mixing.DOMAINS]) / 0.93 * have[0]
    norm = np.linalg.inv((p * t[:, None]).T @ p / scale)

    def objective(r):
        gap = ((t * r) @ p - target) / scale
        return gap @ norm @ gap

    assert objective(rates) <= objective(solve(p, t, target)) + 1e-5
    if sharp == 5:
        assert np.allclose((rates * t) @ p, target, rtol=2e-3)


def test_rates_short_of_the_optimum_are_no_result(spark, monkeypatch):
    p, t, _ = posterior_rows(0.6, 0.3, 2, 500)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p)],
                                 "tokens long, p array<double>")
    monkeypatch.setattr(mixing, "ITERATIONS", 2)
    with pytest.raises(RuntimeError, match="no optimal rates"):
        mixing.fit_rates(rows, {"good": 0.93, "poor": 0.055, "toxic": 0.015})


@pytest.mark.parametrize("poor,toxic,sharp,reachable", [(0.1, 0.0, 9, False), (0.1, 0.0005, 9, False),
                                                        (0.1, 0.0, 5, True)])
def test_weights_of_rare_and_absent_domains_bound_rates_and_report(spark, poor, toxic, sharp,
                                                                   reachable):
    """Soft posteriors hold enough of a domain that no document has on top, sharp ones do not."""
    p, t, _ = posterior_rows(poor, toxic, sharp)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p)],
                                 "tokens long, p array<double>").repartition(3)
    weights = {"good": 0.8, "poor": 0.15, "toxic": 0.05}
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        prices, missed = mixing.solve_rates(rows, weights)
    assert reachable != any("no allowed rates meet" in str(w.message) for w in said)
    rates, scale = mixing.replay(p, prices), t.sum()
    target = np.array([weights[x] for x in mixing.DOMAINS]) / 0.8 * (t @ p)[0]
    assert 0 <= rates.min() and rates.max() <= mixing.MOST_RATE
    assert reachable == (np.abs(missed).max() <= mixing.MISSED * target.sum())
    assert np.allclose(missed, (t * rates) @ p - target, atol=1e-6 * scale)
    norm = np.linalg.inv((p * t[:, None]).T @ p / scale + mixing.LEAST_NORM * np.eye(3))

    def objective(r):
        gap = ((t * r) @ p - target) / scale
        return gap @ norm @ gap / 2 + mixing.NEARNESS * np.average((r - 1) ** 2, weights=t) / 2

    best = objective(rates)
    rng = np.random.default_rng(1)
    for _ in range(200):  # no feasible step near by is better
        step = rng.standard_normal(3) * 10.0 ** rng.integers(-3, 2)
        assert best <= objective(np.clip(rates + p @ step, 0, mixing.MOST_RATE)) + 1e-7


@pytest.mark.parametrize("poor,toxic,sharp", [(0.1, 0.002, 9), (0.1, 0.005, 5), (0.1, 0.0, 9),
                                              (0.0, 0.0, 5), (0.3, 0.3, 5), (0.3, 0.3, 2)])
def test_cleaning_with_rare_absent_and_frequent_toxic_documents(spark, poor, toxic, sharp):
    p, t, _ = posterior_rows(poor, toxic, sharp)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p)],
                                 "tokens long, p array<double>").repartition(3)
    rates = mixing.replay(p, mixing.fit_rates(rows, corpus_pipeline.MIXTURE), True)
    have, got, top = t @ p, (rates * t) @ p, p.argmax(axis=1)
    carried = (t * (top == 0)) @ p
    assert (rates[top == 0] >= 1).all() and (rates[top != 0] <= 1).all()
    assert got[0] >= 0.999 * have[0] and (got[1:] <= 1.001 * have[1:]).all()
    assert (got[1:] >= 0.999 * carried[1:]).all()
    assert got[2] <= 1.05 * carried[2] * have[0] / carried[0]
    if (top == 2).any():
        assert np.average(rates[top == 2], weights=t[top == 2]) < 0.15
    if (top == 1).any():
        assert np.average(rates[top == 1], weights=t[top == 1]) < 0.9
