"""Training, scoring and evaluating Spark ML classifiers on TF-IDF features."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.sql import DataFrame, functions as F

from chorus.config import (BoostConfig, ForestConfig, LogRegConfig, SvmConfig, TfidfConfig,
                           Word2VecConfig)
from chorus.functions import scores
from chorus.operators import compare, labels, metrics, tfidf
from chorus.operators.split import stratified_split
from chorus.plans import stages, wordvec
from chorus.plans.boosting import SoftmaxBoosting
from chorus.plans.forest import SparseForest
from chorus.plans.svm import SquaredHingeSvm
from chorus.workspace import shared_dir, stage


@dataclass(frozen=True)
class Features:
    """Staged feature table and the lookups needed to score new texts."""

    table: DataFrame  # id, y_true, label, split, features
    vocab: DataFrame
    classes: tuple[str, ...]
    size: int
    config: TfidfConfig
    id_col: str


def prepare(df: DataFrame, id_col: str, text: str, label: str, classes: Sequence[str],
            config: TfidfConfig = TfidfConfig()) -> Features:
    """Split, fit the vocabulary on the training rows, transform all rows.

    The feature table is written once to the shared folder: every iteration of a
    trainer, and every trainer, reads it instead of the text.
    """
    classes = tuple(sorted(classes))
    parted = stratified_split(df.select(id_col, text, label), id_col, label)
    train = parted.filter(F.col("split") == "train")
    vocab = tfidf.vocabulary(train, id_col, text, config)
    size = max(vocab.count(), 1)
    mapping = labels.label_mapping(df, label)
    rows = labels.encode_labels(parted, label, mapping).select(
        id_col, text, F.col(label).alias("y_true"),
        F.col("label_id").cast("double").alias("label"), "split")
    table = tfidf.vectors(rows, id_col, text, vocab, size, config, keep=["y_true", "label", "split"])
    return Features(stage(table, "features"), vocab, classes, size, config, id_col)


def train_rows(features: Features) -> DataFrame:
    return features.table.filter((F.col("split") == "train") & F.col("label").isNotNull())


def train_logreg(features: Features, config: LogRegConfig = LogRegConfig()) -> Model:
    rows = train_rows(features)
    return LogisticRegression(
        family="multinomial", regParam=1.0 / (config.c * max(rows.count(), 1)),
        elasticNetParam=0.0, standardization=False, maxIter=config.max_iter,
        tol=config.tol).fit(rows)


def train_forest(features: Features, config: ForestConfig = ForestConfig()) -> Model:
    return SparseForest(len(features.classes), features.id_col, config).fit(train_rows(features))


def train_boosting(features: Features, config: BoostConfig = BoostConfig()) -> Model:
    """Softmax boosting: a tree per class and round on shared residuals."""
    return SoftmaxBoosting(len(features.classes), features.id_col, config).fit(train_rows(features))


def train_bayes(features: Features, alpha: float = 1.0) -> Model:
    return NaiveBayes(smoothing=alpha, modelType="multinomial").fit(train_rows(features))


def train_svm(features: Features, config: SvmConfig = SvmConfig()) -> Model:
    """Linear SVM with squared hinge loss, one per class; it gives no probabilities."""
    return SquaredHingeSvm(len(features.classes), features.id_col, config).fit(train_rows(features))


def train_word2vec(rows: DataFrame, words: str,
                   config: Word2VecConfig = Word2VecConfig()) -> wordvec.WordVectors:
    """Skip-gram word vectors, trained on one part per core, or more, and averaged."""
    return wordvec.train(rows, words, config)


def predict(model: Model, rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Predicted class, and where the model has them probabilities and confidence."""
    out = model.transform(rows)
    kept = [c for c in rows.columns if c not in ("features", "label")]
    scored = out.select(*kept, *stages.named_columns(out, list(classes)))
    return scored.withColumn("correct", F.col("y_true") == F.col("y_pred")) \
        if "y_true" in kept else scored


def evaluate(predicted: DataFrame, classes: Sequence[str], by: Sequence[str] = ("split",)) -> DataFrame:
    """Accuracy, F1 means and macro AUC (null without probabilities) per group."""
    matrix = metrics.confusion(predicted, classes, by)
    figures = metrics.overall(matrix, by)
    if f"prob_{classes[0]}" not in predicted.columns:
        return figures.withColumn("roc_auc", F.lit(None).cast("double"))
    points = metrics.one_vs_rest(predicted, {c: f"prob_{c}" for c in classes}, by)
    return figures.join(metrics.macro_auc(metrics.roc_auc(points, by), by), list(by))


def train_and_evaluate(features: Features, name: str, trainer: Callable[[Features], Model]) -> DataFrame:
    """One result row per split for one trainer."""
    scored = stage(predict(trainer(features), features.table, features.classes), f"predictions-{name}")
    return evaluate(scored, features.classes).select(F.lit(name).alias("model"), "*")


def select_on_validation(features: Features, candidates: Sequence[tuple[str, Callable[[Features], Model]]],
                         patience: int = 3) -> tuple[str, Model, DataFrame]:
    """Train candidates in order and keep the best macro F1 on the validation rows.

    Stops after ``patience`` candidates in a row that do not improve it.
    """
    held_out = features.table.filter(F.col("split") == "val")
    best_name, best_model, best, history, waited = "", None, -1.0, [], 0
    for name, trainer in candidates:
        model = trainer(features)
        matrix = metrics.confusion(predict(model, held_out, features.classes), features.classes)
        value = metrics.overall(matrix).first()["f1_macro"]
        history.append((name, value))
        if value > best:
            best_name, best_model, best, waited = name, model, value, 0
        else:
            waited += 1
            if waited >= patience:
                break
    spark = features.table.sparkSession
    table = spark.createDataFrame(history, "candidate string, f1_macro double")
    return best_name, best_model, table.withColumn("best", F.col("candidate") == best_name)


def linear_weights(model: Model, spark) -> DataFrame:
    """(class, feature, weight) of a fitted logistic regression, the intercept after the last."""
    matrix = model.coefficientMatrix.toArray()
    rows = [(int(k), int(f), float(matrix[k, f])) for k, f in zip(*matrix.nonzero())]
    rows += [(k, matrix.shape[1], float(b)) for k, b in enumerate(model.interceptVector)]
    return stage(spark.createDataFrame(rows, "class int, feature int, weight double"), "weights")


def top_coefficients(model: Model, features: Features, k: int = 20) -> DataFrame:
    """The terms with the largest absolute coefficients per class."""
    matrix = model.coefficientMatrix.toArray()
    spark = features.table.sparkSession
    rows = [(c, int(i), float(matrix[r][i])) for r, c in enumerate(features.classes)
            for i in sorted(range(matrix.shape[1]), key=lambda j: (-abs(matrix[r][j]), j))[:k]]
    table = spark.createDataFrame(rows, "class string, term_id int, coefficient double")
    return table.join(features.vocab.select("term", "term_id"), "term_id")


def save_and_load(model: Model, spark) -> Model:
    """Write a fitted model to the shared folder and read it back."""
    path = shared_dir(spark, "model")
    model.write().overwrite().save(path)
    return type(model).load(path)


def scoring_pipeline(model: Model, features: Features, text: str) -> PipelineModel:
    """Vocabulary, class mapping and model as one pipeline from raw text to class names.

    It can be saved, loaded and used without anything else.
    """
    return PipelineModel([
        stages.ClassMappingModel(inputCol="class", outputCol="label", classes=list(features.classes)),
        stages.vectorizer(features.vocab, features.size, features.config, text, features.id_col),
        model, stages.ClassNames(classes=list(features.classes))])


def keep_best(results: DataFrame, fitted: Mapping[str, Model], features: Features, text: str,
              path: str, metric: str = "f1_macro") -> str:
    """Save the scoring pipeline of the model with the best test figure; returns its name."""
    tested = results.filter(F.col("split") == "test")
    best = compare.leaderboard(tested, metric).filter("rank = 1").first()["model"]
    scoring_pipeline(fitted[best], features, text).write().overwrite().save(f"{path}/{best}")
    return best


def score_texts(model: Model, features: Features, texts: DataFrame, text: str,
                id_col: str) -> DataFrame:
    """Class, class id, probability per class and confidence of new texts."""
    vec = tfidf.vectors(texts.select(id_col, text), id_col, text, features.vocab, features.size,
                        features.config)
    return predict(model, vec, features.classes)


def respond(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Response records: the class and the rounded confidence of every class."""
    probabilities = F.array(*[f"prob_{c}" for c in classes])
    return scored.withColumn("confidence_by_class", scores.confidence_map(classes, probabilities))
