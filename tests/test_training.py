"""Trainers with passes of their own, against plain numpy on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from chorus.catalog.training import CLASSES, features
from chorus.config import BoostConfig, SvmConfig, TfidfConfig
from chorus.plans import blocks, boosting, models, optimality, stages, svm
from chorus.workspace import shared_dir


def table(spark, x, y, dense=False):
    rows = [(i, float(c), Vectors.dense(v) if dense or i % 3 == 0 else
             Vectors.sparse(len(v), [(j, float(a)) for j, a in enumerate(v) if a]))
            for i, (v, c) in enumerate(zip(x.tolist(), y.tolist()))]
    return spark.createDataFrame(rows, ["id", "label", "features"])


@pytest.fixture(scope="module")
def few():
    """Few distinct values per feature, so that every value is a bin."""
    rng = np.random.default_rng(3)
    levels = np.round(rng.uniform(0.1, 2, (7, 4)), 6)
    x = np.stack([np.where(rng.random(240) < 0.4, 0, levels[j][rng.integers(0, 4, 240)])
                  for j in range(7)], axis=1)
    y = (x[:, 0] + x[:, 1] > 1.2).astype(int) + (x[:, 2] > 0.8) * (x[:, 3] == 0)
    return x, np.where(rng.random(240) < 0.1, rng.integers(0, 3, 240), y)


def grow(x, residual, curvature, classes, depth, least):
    """Every threshold between two values of every feature, by plain sums; (leaf of rows, gains)."""
    leaf_values, gains = np.zeros(len(x)), []
    nodes = [np.arange(len(x))]
    for _ in range(depth):
        following = []
        for rows in nodes:
            best = (1e-12,)
            for j in range(x.shape[1]):
                values = np.unique(np.append(x[rows, j], 0.0))
                for t in values[:-1]:
                    right = rows[x[rows, j] > t]
                    left = rows[x[rows, j] <= t]
                    if len(left) and len(right):
                        apart = residual[left].mean() - residual[right].mean()
                        gain = len(left) * len(right) / len(rows) * apart ** 2
                        if gain > best[0] + 1e-12:
                            best = (gain, left, right)
            if len(best) == 1:
                continue
            gains.append(best[0])
            for part in best[1:]:
                leaf_values[part] = ((classes - 1) / classes * residual[part].sum()
                                     / curvature[part].sum())
                if len(part) >= least:
                    following.append(part)
        nodes = following
    return leaf_values, gains


def brute_boost(x, y, classes, config):
    scores = np.tile(np.log(np.bincount(y, minlength=classes) / len(y)), (len(y), 1))
    gains = []
    for _ in range(config.rounds):
        p = boosting.softmax(scores)
        grown = [grow(x, (y == k) - p[:, k], p[:, k] * (1 - p[:, k]), classes, config.max_depth,
                      config.min_split) for k in range(classes)]
        for k, (values, found) in enumerate(grown):
            scores[:, k] += config.step * values
            gains.append(found)
    return boosting.softmax(scores), gains


def fitted(df, classes, config):
    return boosting.SoftmaxBoosting(classes, "id", config).fit(df)


def probabilities(model, df):
    rows = model.transform(df).select("id", "probability", "prediction").orderBy("id").collect()
    assert all(r.prediction == np.argmax(r.probability.toArray()) for r in rows)
    return np.array([r.probability.toArray() for r in rows])


CONFIG = BoostConfig(rounds=4, max_depth=3, step=0.3)


def test_splits_and_probabilities_equal_a_plain_grower(spark, few):
    x, y = few
    df = table(spark, x, y)
    model = fitted(df, 3, CONFIG)
    want, gains = brute_boost(x, y, 3, CONFIG)
    got = [sorted(g for g, f in zip(t.gain, t.feature) if f >= 0) for r in model.trees for t in r]
    for a, b in zip(got, gains):
        assert np.allclose(a, sorted(b), rtol=1e-9)
    assert np.allclose(probabilities(model, df), want, atol=1e-9)


def test_the_number_of_blocks_and_of_rounds_replayed_changes_nothing(spark, few, monkeypatch):
    x, y = few
    df = table(spark, x, y)
    config = BoostConfig(rounds=12, max_depth=2)
    one = probabilities(fitted(df, 3, config), df)
    monkeypatch.setattr(blocks, "ENTRIES", 250)
    monkeypatch.setattr(boosting, "REPLAY", 3)
    assert np.allclose(probabilities(fitted(df, 3, config), df), one, atol=1e-9)


def test_boosted_trees_are_saved_and_loaded(spark, few):
    x, y = few
    df = table(spark, x, y)
    model = fitted(df, 3, CONFIG)
    again = models.save_and_load(model, spark)
    assert np.array_equal(probabilities(again, df), probabilities(model, df))
    assert again.table(spark).collect() == model.table(spark).collect()


def test_awkward_training_rows(spark):
    """One class without rows, rows without entries, one row, and features of one value."""
    x = np.array([[0.0, 0, 1]] * 6 + [[2.0, 0, 1]] * 6)
    df = table(spark, x, np.array([0] * 6 + [2] * 6))
    p = probabilities(fitted(df, 3, BoostConfig(rounds=3, min_split=2)), df)
    assert (p[:6].argmax(axis=1) == 0).all() and (p[6:].argmax(axis=1) == 2).all()
    assert (p[:, 1] < 1e-6).all()
    single = table(spark, np.zeros((1, 3)), np.array([1]))
    assert probabilities(fitted(single, 2, BoostConfig(rounds=2)), single).argmax() == 1
    with pytest.raises(Exception, match="zero or positive"):
        fitted(table(spark, -x, np.zeros(12, int)), 2, BoostConfig(rounds=1))


@pytest.fixture(scope="module")
def f(spark, data):
    return features(spark, data)


def test_no_worse_than_one_against_the_rest(spark, f):
    rows = models.train_rows(f)
    ours = models.train_boosting(f, BoostConfig(rounds=5, max_depth=2))
    rest = OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=2, stepSize=0.1)).fit(rows)
    right = [model.transform(f.table.filter("split = 'test'")).agg(
        F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] for model in (ours, rest)]
    assert right[0] >= right[1]


def svm_gradient(x, y, w, c):
    """Objective and gradient with a constant feature, for labels 1 and -1."""
    wide = np.column_stack([x, np.ones(len(x))])
    short = np.maximum(1 - y * (wide @ w), 0)
    return w @ w / 2 + c * (short ** 2).sum(), w - 2 * c * wide.T @ (y * short)


def test_svm_reaches_the_optimum(spark, few):
    x, y = few
    df = table(spark, x, y)
    model = svm.SquaredHingeSvm(3, "id", SvmConfig(tol=1e-7)).fit(df)
    for k in range(3):
        signs = np.where(y == k, 1.0, -1.0)
        value, gradient = svm_gradient(x, signs, model.weights[:, k], 1.0)
        assert np.linalg.norm(gradient) < 1e-5 and model.norms[k] <= model.goals[k]
        w, step = np.zeros(8), 1.0
        for _ in range(4000):  # plain descent
            old, g = svm_gradient(x, signs, w, 1.0)
            while svm_gradient(x, signs, w - step * g, 1.0)[0] > old - step * (g @ g) / 2:
                step /= 2
            w, step = w - step * g, step * 1.5
            if np.linalg.norm(g) < 1e-9:
                break
        assert value <= svm_gradient(x, signs, w, 1.0)[0] + 1e-8
    norms = optimality.squared_hinge_norms(df, "id", "label", model.table(spark), 7, 3, 1.0)
    assert np.allclose([r.norm for r in norms.orderBy("class").collect()], model.norms, atol=1e-9)
    rows = model.transform(df).orderBy("id").collect()
    m = np.column_stack([x, np.ones(len(x))]) @ model.weights
    assert np.allclose([r.rawPrediction.toArray() for r in rows], m)
    assert [r.prediction for r in rows] == m.argmax(axis=1).tolist()
    again = models.save_and_load(model, spark)
    assert np.array_equal(again.weights, model.weights) and again.norms == model.norms


def test_svm_with_a_class_without_rows_and_empty_rows(spark):
    x = np.array([[0.0, 0]] * 4 + [[1.0, 0]] * 4 + [[0, -1.0]])
    df = table(spark, x, np.array([0] * 4 + [2] * 5))
    model = svm.SquaredHingeSvm(3, "id").fit(df)
    got = [r.prediction for r in model.transform(df).orderBy("id").collect()]
    assert got[:8] == [0.0] * 4 + [2.0] * 4 and set(got) <= {0.0, 2.0}


def test_entries_of_mixed_vectors(spark):
    df = spark.createDataFrame([(Vectors.dense([0, 1.5, 0]),), (Vectors.sparse(3, [2], [0.0]),),
                                (Vectors.sparse(3, [0], [2.0]),)], ["features"])
    assert blocks.table_size(df) == (3, 2)
    assert sorted(map(tuple, blocks.long_form(df).collect())) == [(0, 2.0), (1, 1.5)]


def test_a_pipeline_scores_raw_text_after_loading(spark, data):
    """Mapping, vocabulary and classifier are saved and loaded as one."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    line = Pipeline(stages=[
        stages.ClassMapping(inputCol="lang", outputCol="label"),
        stages.TermVectorizer("text", "features", "doc_id", TfidfConfig(max_features=300)),
        LogisticRegression(maxIter=5), stages.ClassNames(classes=list(CLASSES))])
    fitted_line = line.fit(docs)
    path = shared_dir(spark, "test-pipeline")
    fitted_line.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    assert loaded.stages[0].getClasses() == list(CLASSES)
    want = {r.doc_id: r.asDict() for r in fitted_line.transform(docs).collect()}
    got = {r.doc_id: r.asDict() for r in loaded.transform(docs).collect()}
    assert got == want and len(got) == docs.count()
    new = loaded.transform(docs.select("doc_id", "text")).collect()
    assert {r.doc_id: r.y_pred for r in new} == {i: r["y_pred"] for i, r in want.items()}
    assert sum(r["y_pred"] == r["lang"] for r in want.values()) > 0.9 * len(want)


def test_names_that_are_not_known_have_no_id(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "class string")
    model = stages.ClassMapping(inputCol="class", outputCol="label").fit(df.filter("class < 'c'"))
    assert {r["class"]: r.label for r in model.transform(df).collect()} == {
        "a": 0.0, "b": 1.0, None: None, "c": None}
