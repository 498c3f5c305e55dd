"""Named queries: trained models, all with the defaults of the library.

The feature table and the fitted models of a data folder are made once per Spark
application and shared by the queries; what is kept are handles on staged tables
and models of bounded size.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from chorus.catalog.registry import query
from chorus.catalog.text import STOPS, TOKENS
from chorus.config import LogRegConfig, SvmConfig
from chorus.functions import text as tx
from chorus.operators import compare, quality
from chorus.plans import models, optimality
from chorus.sources.tables import documents, load
from chorus.wordlists import STOP_WORDS
from chorus.workspace import shared_dir, stage

CLASSES = ("de", "en", "es", "fr")
TRAINERS = {
    "logistic_regression": models.train_logreg,
    "random_forest": models.train_forest,
    "gradient_boosting": models.train_boosting,
    "naive_bayes": models.train_bayes,
    "linear_svm": models.train_svm,
}

_MADE: dict[tuple, object] = {}


def _once(spark, d, name, make):
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def features(spark, d):
    return _once(spark, d, "features", lambda: models.prepare(
        load(spark, d, "documents"), "doc_id", "text", "lang", CLASSES))


def fitted(spark, d, name):
    return _once(spark, d, name, lambda: TRAINERS[name](features(spark, d)))


def _trained(spark, d, name):
    return models.train_and_evaluate(features(spark, d), name, lambda f: fitted(spark, d, name))


@query()
def train_logreg(spark, d):
    return _trained(spark, d, "logistic_regression")


@query()
def train_forest(spark, d):
    return _trained(spark, d, "random_forest")


@query()
def train_gbt(spark, d):
    return _trained(spark, d, "gradient_boosting")


@query()
def train_bayes(spark, d):
    return _trained(spark, d, "naive_bayes")


@query()
def train_svm(spark, d):
    return _trained(spark, d, "linear_svm")


@query()
def evaluate_models(spark, d):
    """All models on one feature table, ranked by macro F1 on the test rows."""
    rows = compare.collect_results(*[_trained(spark, d, name) for name in TRAINERS])
    return compare.leaderboard(rows.filter(F.col("split") == "test"), "f1_macro")


@query()
def select_on_validation(spark, d):
    f = features(spark, d)
    grid = [(f"C={c}", lambda f, c=c: models.train_logreg(f, LogRegConfig(c=c)))
            for c in (0.1, 1.0, 10.0)]
    return models.select_on_validation(f, grid)[2]


@query()
def top_coefficients(spark, d):
    f = features(spark, d)
    return models.top_coefficients(fitted(spark, d, "logistic_regression"), f, 20)


@query("SELECT count(*) AS rows, count(*) AS equal FROM documents")
def model_roundtrip(spark, d):
    """Raw texts scored by a saved and loaded pipeline alone, against the fitted model."""
    f = features(spark, d)
    model = fitted(spark, d, "naive_bayes")
    path = shared_dir(spark, "pipeline")
    models.scoring_pipeline(model, f, "text").write().save(path)
    texts = load(spark, d, "documents").select("doc_id", "text")
    again = PipelineModel.load(path).transform(texts).select(
        "doc_id", F.col("y_pred").alias("again"), F.col("confidence").alias("confidence_again"))
    first = models.predict(model, f.table, f.classes).select("doc_id", "y_pred", "confidence")
    return texts.select("doc_id").join(first, "doc_id", "left").join(again, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((F.col("y_pred") == F.col("again"))
                   & (F.abs(F.col("confidence") - F.col("confidence_again")) < 1e-9)).alias("equal"))


@query("SELECT count(*) AS rows, count(*) AS equal, true AS best FROM documents")
def best_model(spark, d):
    """The best of all trainers on the test rows is saved, loaded and scores raw texts alike."""
    f = features(spark, d)
    results = stage(compare.collect_results(*[_trained(spark, d, name) for name in TRAINERS]), "results")
    path = shared_dir(spark, "best-model")
    name = models.keep_best(results, {n: fitted(spark, d, n) for n in TRAINERS}, f, "text", path)
    texts = load(spark, d, "documents").select("doc_id", "text")
    again = PipelineModel.load(f"{path}/{name}").transform(texts).select("doc_id", F.col("y_pred").alias("again"))
    first = models.predict(fitted(spark, d, name), f.table, f.classes).select("doc_id", "y_pred")
    test = results.filter(F.col("split") == "test")
    top = test.filter(F.col("model") == name).agg(F.max("f1_macro")).scalar()
    return texts.select("doc_id").join(first, "doc_id").join(again, "doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("y_pred") == F.col("again")).alias("equal")
    ).withColumn("best", top == test.agg(F.max("f1_macro")).scalar())


SPLIT = """ranked AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang
    ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents),
parted AS (SELECT doc_id, lang, text, CASE WHEN rn <= (n * 80) // 100 THEN 'train'
  WHEN rn <= (n * 90) // 100 THEN 'val' ELSE 'test' END AS split FROM ranked)"""


@query(f"""WITH {SPLIT},
words AS (SELECT doc_id, lang, split, list_filter({TOKENS}, lambda x: x NOT IN {STOPS}) AS w FROM parted),
terms AS (SELECT doc_id, lang, split, unnest(list_concat(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term
  FROM words),
tf AS (SELECT doc_id, lang, split, term, count(*) AS tf FROM terms GROUP BY ALL),
size AS (SELECT count(*) AS n_docs FROM parted WHERE split = 'train'),
vocab AS (SELECT term, count(*) AS df FROM tf WHERE split = 'train' GROUP BY term
  HAVING count(*) >= 5 AND count(*) <= 0.95 * (SELECT n_docs FROM size)
  ORDER BY sum(tf) DESC, term LIMIT 10000),
raw AS (SELECT doc_id, lang, split, term, (ln(tf) + 1) * (ln((n_docs + 1) / (df + 1)) + 1) AS r
  FROM tf JOIN vocab USING (term), size),
weighted AS (SELECT doc_id, lang, split, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS weight
  FROM raw),
classes AS (SELECT unnest({list(CLASSES)}) AS c),
sums AS (SELECT lang AS c, term, sum(weight) AS w FROM weighted WHERE split = 'train' GROUP BY ALL),
probs AS (SELECT c, term, ln((coalesce(w, 0.0) + 1) / sum(coalesce(w, 0.0) + 1) OVER (PARTITION BY c)) AS lp
  FROM vocab CROSS JOIN classes LEFT JOIN sums USING (c, term)),
priors AS (SELECT lang AS c, ln((count(*) + 1) / ((SELECT n_docs FROM size) + {len(CLASSES)})) AS prior
  FROM parted WHERE split = 'train' GROUP BY lang),
likely AS (SELECT doc_id, c, sum(weight * lp) AS s FROM weighted JOIN probs USING (term) GROUP BY ALL),
scored AS (SELECT doc_id, split, c, prior + coalesce(s, 0.0) AS s FROM parted CROSS JOIN priors
  LEFT JOIN likely USING (doc_id, c))
SELECT doc_id, split, arg_max(c, s) AS y_pred FROM scored GROUP BY doc_id, split""")
def bayes_predictions(spark, d):
    """The class the naive Bayes model, fitted on the training rows, gives every document."""
    f = features(spark, d)
    return models.predict(fitted(spark, d, "naive_bayes"), f.table, f.classes).select(
        "doc_id", "split", "y_pred")


_SOLVED = f"""WITH {SPLIT} SELECT c AS class, (SELECT count(*) FROM parted WHERE split = 'train') AS rows,
  true AS solved FROM (SELECT unnest({list(CLASSES)}) AS c)"""


def _solved(f, norms, most):
    """Per class: training rows and whether its gradient norm is at most ``most``."""
    names = F.array(*[F.lit(c) for c in f.classes])
    limit = F.element_at(F.array(*[F.lit(float(m)) for m in most]), F.col("class") + 1)
    return norms.select(
        F.element_at(names, F.col("class") + 1).alias("class"),
        models.train_rows(f).agg(F.count(F.lit(1))).scalar().alias("rows"),
        (F.col("norm") <= limit).alias("solved"))


@query(_SOLVED)
def svm_optimality(spark, d):
    """The gradient at the SVM's solution, from its coefficients, is as small as asked for."""
    f = features(spark, d)
    model = fitted(spark, d, "linear_svm")
    norms = optimality.squared_hinge_norms(
        models.train_rows(f), "doc_id", "label", stage(model.table(spark), "weights"), f.size,
        len(f.classes), SvmConfig().c)
    return _solved(f, norms, [g * (1 + 1e-6) for g in model.goals])


@query(_SOLVED)
def logreg_optimality(spark, d):
    """The gradient at the logistic regression's solution is under a hundredth of that at zero."""
    f = features(spark, d)
    rows = models.train_rows(f)
    penalty = 1.0 / (LogRegConfig().c * rows.count())
    norms = lambda w: optimality.softmax_norms(rows, "doc_id", "label", w, f.size, len(f.classes), penalty)
    zero = spark.createDataFrame([], "class int, feature int, weight double")
    start = {r["class"]: r["norm"] for r in norms(zero).collect()}
    found = norms(models.linear_weights(fitted(spark, d, "logistic_regression"), spark))
    return _solved(f, found, [start[k] / 100 for k in range(len(f.classes))])


@query(f"""WITH {SPLIT}, t AS (SELECT count(*) AS rows FROM parted WHERE split = 'test')
SELECT unnest({sorted(TRAINERS)}) AS model, rows, true AS all_classes, true AS beats_majority FROM t""")
def model_checks(spark, d):
    """Every trainer scores all test rows, knows all classes and beats the largest class."""
    f = features(spark, d)
    found = []
    for name in sorted(TRAINERS):
        scored = models.predict(fitted(spark, d, name), f.table.filter(F.col("split") == "test"), f.classes)
        right = F.count_if("correct")
        largest = F.greatest(*[F.count_if(F.col("y_true") == c) for c in f.classes])
        found.append(scored.agg(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("rows"),
            (F.count_distinct("y_pred") == len(f.classes)).alias("all_classes"),
            (right > largest).alias("beats_majority")))
    return compare.collect_results(*found)


@query()
def score_batch(spark, d):
    """Predicted class, probabilities, confidence and correctness of every document."""
    f = features(spark, d)
    return models.predict(fitted(spark, d, "logistic_regression"), f.table, f.classes)


@query()
def score_requests(spark, d):
    """Conversation turns as requests: valid ones scored, refused ones with the reason."""
    f = features(spark, d)
    requests = load(spark, d, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("request_id"), "text")
    checked = quality.validate_requests(requests)
    valid = checked.filter(F.col("reason").isNull())
    model = fitted(spark, d, "logistic_regression")
    scored = models.respond(models.score_texts(model, f, valid, "text", "request_id"), f.classes)
    answers = scored.select("request_id", F.col("y_pred").alias("sentiment"),
                            F.to_json("confidence_by_class").alias("confidence"))
    refused = checked.filter(F.col("reason").isNotNull()).select("request_id", "reason")
    return answers.unionByName(refused, allowMissingColumns=True)


@query()
def word2vec(spark, d):
    words = documents(spark, d, "doc_id", "text").select(
        tx.without(tx.tokens(F.col("text")), STOP_WORDS).alias("words"))
    model = models.train_word2vec(words, "words")
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))
