from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chorus.catalog.training import CLASSES, features
from chorus.config import BoostConfig, ForestConfig, LogRegConfig, SvmConfig
from chorus.operators import lexicon
from chorus.plans import models, pipeline

TRAINERS = {
    "logreg": lambda f: models.train_logreg(f, LogRegConfig(max_iter=20)),
    "forest": lambda f: models.train_forest(f, ForestConfig(trees=10, max_depth=6)),
    "boosting": lambda f: models.train_boosting(f, BoostConfig(rounds=20, max_depth=3)),
    "bayes": models.train_bayes,
    "svm": lambda f: models.train_svm(f, SvmConfig(max_iter=10)),
}


@pytest.fixture(scope="module")
def f(spark, data):
    return features(spark, data)


@pytest.mark.parametrize("name", TRAINERS)
def test_better_than_majority(spark, f, name):
    result = models.train_and_evaluate(f, name, TRAINERS[name])
    rows = {r.split: r for r in result.collect()}
    share = f.table.filter("split = 'test'").groupBy("y_true").count().agg(
        F.max("count") / F.sum("count")).first()[0]
    assert set(rows) == {"train", "val", "test"}
    assert rows["test"].accuracy > share
    assert (rows["test"].roc_auc is None) == (name == "svm")
    assert sum(r.rows for r in rows.values()) == f.table.count()


def test_labels_are_alphabetical(f):
    pairs = {(r.y_true, r.label) for r in f.table.select("y_true", "label").distinct().collect()}
    assert pairs == {(c, float(i)) for i, c in enumerate(CLASSES)}


def test_validation_choice_and_patience(f):
    calls = []

    def candidate(c):
        def train(features):
            calls.append(c)
            return models.train_logreg(features, LogRegConfig(c=c, max_iter=3))
        return f"C={c}", train

    name, model, history = models.select_on_validation(
        f, [candidate(c) for c in (1.0, 1.0, 1.0, 1.0)], patience=2)
    assert name == "C=1.0" and len(calls) == 3 and history.count() == 3


def test_probabilities_and_response(spark, f):
    texts = spark.createDataFrame([("r1", "the and of the that with"), ("r2", "zzz")],
                                  "request_id string, text string")
    scored = models.respond(models.score_texts(TRAINERS["bayes"](f), f, texts, "text", "request_id"),
                            f.classes).collect()
    assert len(scored) == 2
    for r in scored:
        assert abs(sum(r[f"prob_{c}"] for c in CLASSES) - 1) < 1e-9
        assert r.confidence == max(r[f"prob_{c}"] for c in CLASSES)
        assert set(r.confidence_by_class) == set(CLASSES)


def test_all_stages(spark, data):
    """Clean, classify, score, label and split in one plan; no row is lost."""
    words = spark.createDataFrame([("good", 200), ("bad", -250)], "word string, valence bigint")
    posts = spark.createDataFrame(
        [(i, t) for i, t in enumerate(["good day @x", "bad day", "a day", "@x", "good good bad"] * 20)],
        "id bigint, text string")
    out = pipeline.label_and_split(posts, "id", "text", F.lit("en"), words)
    rows = out.collect()
    assert len(rows) == 80
    assert {r.sentiment for r in rows if r.cleaned_text == "good day"} == {"Positive"}
    assert {r.sentiment for r in rows if r.cleaned_text == "bad day"} == {"Negative"}
    assert {r.sentiment for r in rows if r.cleaned_text == "a day"} == {"Neutral"}
    assert {r.split for r in rows} == {"train", "val", "test"}


def test_lexicon_scores(spark):
    words = spark.createDataFrame([("good", 200), ("bad", -250)], "word string, valence bigint")
    texts = spark.createDataFrame([(1, "good day, bad day"), (2, ""), (3, None)], "id int, t string")
    got = {r.id: r for r in lexicon.label_sentiment(texts, "id", "t", words).collect()}
    s = -0.5
    assert got[1].vader_compound == round(s / (s * s + 15) ** 0.5, 4)
    assert got[1].vader_positive == round(3 / 8.5, 3) and got[1].vader_neutral == round(2 / 8.5, 3)
    assert got[1].textblob_polarity == (2 - 2.5) / 4 / 2
    assert got[1].textblob_subjectivity == 1.0
    for i in (2, 3):
        assert (got[i].vader_neutral, got[i].vader_compound, got[i].textblob_subjectivity) == (1, 0, 0)
