"""Published confusion matrices and model comparisons must give the published figures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chorus.operators import compare, metrics, profile

CLASSES = ("Negative", "Neutral", "Positive")

# Confusion matrices with their accuracy, macro F1, weighted F1 and errors.
GOLDEN = {
    "logistic": ([[1345, 388, 355], [53, 5519, 149], [182, 551, 4619]], 0.8725, 0.8405, 0.8690, 1678),
    "transformer_a": ([[1580, 264, 244], [70, 5519, 132], [172, 380, 4800]], 0.9041, 0.8830, 0.9028, 1262),
    "transformer_b": ([[1932, 37, 119], [63, 5552, 106], [96, 44, 5212]], 0.9647, 0.9563, 0.9647, 465),
    "multilingual": ([[1580, 264, 244], [70, 5519, 132], [172, 379, 4801]], 0.9042, 0.8830, 0.9029, 1261),
}
# Six model results.
RESULTS = [
    ("Phase 2", "Logistic Regression", "Classical ML", 0.8725, 0.8512, 0.8698),
    ("Phase 2", "Linear SVM", "Classical ML", 0.8857, 0.8663, 0.8834),
    ("Phase 2", "Gradient Boosting", "Ensemble", 0.7543, 0.7125, 0.7489),
    ("Phase 2", "Random Forest", "Ensemble", 0.7316, 0.6845, 0.7254),
    ("Phase 2", "Naive Bayes", "Probabilistic", 0.7139, 0.6723, 0.7092),
    ("Phase 3", "DistilBERT", "Transformer", 0.9647, 0.9563, 0.9647),
]


@pytest.fixture(scope="module")
def matrix(spark):
    cells = [(m, t, p, n) for m, (rows, *_) in GOLDEN.items()
             for t, row in zip(CLASSES, rows) for p, n in zip(CLASSES, row)]
    counts = spark.createDataFrame(cells, "model string, y_true string, y_pred string, n int")
    pairs = counts.select("model", "y_true", "y_pred", F.explode(F.sequence(F.lit(1), "n")))
    return metrics.confusion(pairs, CLASSES, ["model"])


def test_golden_figures(matrix):
    got = {r.model: r for r in metrics.overall(matrix, ["model"]).collect()}
    for model, (_, accuracy, macro, weighted, errors) in GOLDEN.items():
        r = got[model]
        assert (round(r.accuracy, 4), round(r.f1_macro, 4), round(r.f1_weighted, 4)) == (
            accuracy, macro, weighted)
        assert r.rows == 13161
    wrong = metrics.class_errors(matrix, ["model"]).groupBy("model").agg(F.sum("errors"))
    assert dict(wrong.collect()) == {m: g[4] for m, g in GOLDEN.items()}


def test_golden_classes(matrix):
    per = {(r.model, r["class"]): r for r in metrics.per_class(matrix, ["model"]).collect()}
    b = [per["transformer_b", c] for c in CLASSES]
    assert [round(r.precision, 4) for r in b] == [0.9240, 0.9856, 0.9586]
    assert [round(r.recall, 4) for r in b] == [0.9253, 0.9705, 0.9738]
    assert [r.support for r in b] == [2088, 5721, 5352]
    a = [per["logistic", c] for c in CLASSES]
    assert [round(r.precision, 4) for r in a] == [0.8513, 0.8546, 0.9016]
    assert [round(r.recall, 4) for r in a] == [0.6442, 0.9647, 0.8630]


def test_golden_errors(matrix):
    one = matrix.filter(F.col("model") == "transformer_b")
    rates = {r["class"]: round(r.error_rate * 100, 2) for r in metrics.class_errors(one, ["model"]).collect()}
    assert rates == {"Negative": 7.47, "Neutral": 2.95, "Positive": 2.62}
    for by in (["model"], []):
        e = metrics.error_extremes(one if by else one.drop("model"), by).first()
        assert (e.confused_true, e.confused_as, e.confused_n) == ("Negative", "Positive", 119)
        assert (e.hardest_class, e.best_class) == ("Negative", "Positive")


def test_empty_cells_and_absent_classes(spark):
    pred = spark.createDataFrame([("Neutral", "Neutral"), ("Neutral", "Positive")],
                                 "y_true string, y_pred string")
    grid = metrics.confusion(pred, CLASSES)
    assert grid.count() == 9
    assert metrics.overall(grid).first().f1_macro == round((2 / 3 + 0) / 2, 6)


@pytest.mark.parametrize("seed", [1, 2])
def test_auc_against_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), round(rng.random(), 1 + seed % 2)) for _ in range(300)]
    pred = spark.createDataFrame(rows, "y_true string, p double")
    points = metrics.one_vs_rest(pred, {"a": "p"})
    got = metrics.roc_auc(points).first().auc
    up, down = [p for t, p in rows if t == "a"], [p for t, p in rows if t == "b"]
    want = sum((x > y) + (x == y) / 2 for x in up for y in down) / (len(up) * len(down))
    assert abs(got - want) < 1e-6
    curve = metrics.roc_curve(points).orderBy("fpr", "tpr").collect()
    xs, ys = [0.0] + [r.fpr for r in curve], [0.0] + [r.tpr for r in curve]
    area = sum((xs[i] - xs[i - 1]) * (ys[i] + ys[i - 1]) / 2 for i in range(1, len(xs)))
    assert abs(area - want) < 1e-4 and (xs[-1], ys[-1]) == (1.0, 1.0)


def test_auc_is_null_with_one_class(spark):
    pred = spark.createDataFrame([("a", 0.5), ("a", 0.7)], "y_true string, p double")
    assert metrics.roc_auc(metrics.one_vs_rest(pred, {"a": "p"})).first().auc is None


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(
        RESULTS, "phase string, model string, type string, accuracy double, f1_macro double, "
                 "f1_weighted double")


def test_golden_ranking(results):
    ranked = compare.leaderboard(results, "accuracy").orderBy("rank").collect()
    assert [r.model for r in ranked] == ["DistilBERT", "Linear SVM", "Logistic Regression",
                                         "Gradient Boosting", "Random Forest", "Naive Bayes"]
    best = {r.phase: r.model for r in compare.best_per_group(results, "phase", "accuracy").collect()}
    assert best == {"Phase 2": "Linear SVM", "Phase 3": "DistilBERT"}


def test_golden_gain(results):
    gain = {r.model: r for r in compare.baseline_delta(results, "Linear SVM", ["accuracy", "f1_macro"]).collect()}
    r = gain["DistilBERT"]
    assert (round(r.accuracy_points, 2), round(r.accuracy_relative_pct, 2)) == (7.90, 8.92)
    assert round(r.f1_macro_points, 2) == 9.00


def test_golden_types(results):
    t = {r.type: r for r in compare.type_summary(results, "type", ["accuracy", "f1_macro"]).collect()}
    assert (t["Classical ML"].accuracy_mean, t["Classical ML"].f1_macro_mean) == (0.8791, 0.8588) or \
        (t["Classical ML"].accuracy_mean, t["Classical ML"].f1_macro_mean) == (0.8791, 0.8587)
    assert t["Ensemble"].accuracy_mean in (0.7429, 0.7430) and t["Ensemble"].f1_macro_mean == 0.6985
    assert t["Transformer"].accuracy_std is None


def test_scores_that_are_missing_or_nan_take_no_part(spark):
    nan = float("nan")
    rows = [("a", 0.9, 0.1), ("a", nan, 0.4), ("b", 0.2, None), ("b", 0.6, 0.7), ("a", None, nan)]
    pred = spark.createDataFrame(rows, "y_true string, pa double, pb double")
    points = metrics.one_vs_rest(pred, {"a": "pa", "b": "pb"})
    auc = {r["class"]: r.auc for r in metrics.roc_auc(points).collect()}
    assert auc == {"a": 1.0, "b": 1.0}
    assert all(r.tpr is not None for r in metrics.roc_curve(points).collect())
    none = metrics.one_vs_rest(pred.withColumn("pa", F.lit(nan)), {"a": "pa", "b": "pb"})
    assert metrics.macro_auc(metrics.roc_auc(none)).first()[0] is None


def test_nan_is_in_no_bin_and_no_trend(spark):
    nan = float("nan")
    rows = [(float(i), 2.0 * i) for i in range(10)] + [(nan, 1.0), (3.0, nan), (None, 2.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    bins = {r.bin: (r.n, r.low) for r in profile.histogram(df, "x", 3).collect()}
    assert bins == {0: (3, 0.0), 1: (4, 3.0), 2: (4, 6.0)}
    assert sum(r.n for r in profile.binned_trend(df, "x", "y", 3).collect()) == 10
