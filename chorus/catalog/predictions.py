"""Named queries: evaluation and comparison of prediction tables.

The prediction table is derived from the documents: four simple voters guess the
language of every text from words or letters that are frequent in it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chorus.catalog.derive import lit
from chorus.catalog.registry import query
from chorus.operators import compare, labels, metrics
from chorus.sources.tables import documents, load
from chorus.workspace import stage

CLASSES = ("de", "en", "es", "fr")
VOTERS = {
    "all_words": ("Lexical", {"de": (" der ", " die ", " und ", " den "),
                              "en": (" the ", " of ", " and ", " is "),
                              "es": (" el ", " los ", " que ", " por "),
                              "fr": (" le ", " les ", " et ", " des ")}),
    "one_word": ("Lexical", {"de": (" der ",), "en": (" the ",), "es": (" el ",), "fr": (" le ",)}),
    "letters": ("Character", {"de": ("ä", "ö", "ü", "ß"), "en": ("th", "wh", "ly"),
                              "es": ("ó", "ñ", "í", "á"), "fr": ("è", "ê", "ç", "é")}),
    "majority": ("Constant", {"de": (), "en": (" ",), "es": (), "fr": ()}),
}


def predictions(spark, d):
    text = F.concat(F.lit(" "), F.lower(F.translate("text", "\n\t.,", "    ")), F.lit(" "))
    docs = documents(spark, d, "doc_id", "lang", "text").withColumn("_t", text)

    def votes(marks):
        found = [(F.length("_t") - F.length(F.replace(F.col("_t"), F.lit(m), F.lit("")))) / len(m)
                 for m in marks]
        return sum(found, F.lit(0.0))

    rows = docs.select("doc_id", F.col("lang").alias("y_true"), F.explode(F.array(*[
        F.struct(F.lit(model).alias("model"), F.lit(kind).alias("type"),
                 *[votes(marks[c]).alias(c) for c in CLASSES])
        for model, (kind, marks) in VOTERS.items()])).alias("v")).select("doc_id", "y_true", "v.*")
    total = sum((F.col(c) for c in CLASSES), F.lit(0.0)) + len(CLASSES)
    shared = rows.select("doc_id", "y_true", "model", "type",
                         *[((F.col(c) + 1) / total).alias(f"prob_{c}") for c in CLASSES])
    best = F.greatest(*[f"prob_{c}" for c in CLASSES])
    guess = F.coalesce(*[F.when(F.col(f"prob_{c}") == best, c) for c in CLASSES])
    return shared.withColumns({"confidence": best, "y_pred": guess}).withColumn(
        "correct", F.col("y_true") == F.col("y_pred"))


def _sql_votes(marks):
    return " + ".join(["0.0::DOUBLE"] + [f"(length(t) - length(replace(t, {lit(m)}, ''))) / {len(m)}"
                                 for m in marks])


_UNION = " UNION ALL ".join(
    f"SELECT doc_id, lang AS y_true, '{model}' AS model, '{kind}' AS type, "
    + ", ".join(f"{_sql_votes(marks[c])} AS {c}" for c in CLASSES) + " FROM padded"
    for model, (kind, marks) in VOTERS.items())
_TOTAL = "(0.0::DOUBLE + de + en + es + fr + 4)"
PRED = f"""padded AS (SELECT doc_id, lang, ' ' || lower(translate(text, chr(10) || chr(9) || '.,', '    '))
    || ' ' AS t FROM documents),
voted AS ({_UNION}),
shared AS (SELECT doc_id, y_true, model, type, """ + ", ".join(
    f"({c} + 1) / {_TOTAL} AS prob_{c}" for c in CLASSES) + """ FROM voted),
best AS (SELECT *, greatest(prob_de, prob_en, prob_es, prob_fr) AS confidence FROM shared),
pred AS (SELECT *, y_true = y_pred AS correct FROM (SELECT *, CASE confidence WHEN prob_de THEN 'de'
  WHEN prob_en THEN 'en' WHEN prob_es THEN 'es' ELSE 'fr' END AS y_pred FROM best)),
classes AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS c),
models AS (SELECT DISTINCT model, type FROM pred),
matrix AS (SELECT m.model, m.type, a.c AS y_true, b.c AS y_pred, count(p.doc_id) AS n
  FROM models m CROSS JOIN classes a CROSS JOIN classes b
  LEFT JOIN pred p ON p.model = m.model AND p.y_true = a.c AND p.y_pred = b.c GROUP BY ALL),
support AS (SELECT model, type, y_true AS class, sum(n) AS support,
  sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS correct FROM matrix GROUP BY ALL),
guessed AS (SELECT model, y_pred AS class, sum(n) AS predicted FROM matrix GROUP BY ALL),
per_class AS (SELECT model, type, class, support, predicted, correct,
  coalesce(correct / nullif(predicted, 0), 0.0) AS precision,
  coalesce(correct / nullif(support, 0), 0.0) AS recall,
  coalesce(correct * 2.0 / nullif(support + predicted, 0), 0.0) AS f1
  FROM support JOIN guessed USING (model, class)),
results AS (SELECT model, type, round(sum(correct) / sum(support), 6) AS accuracy,
  round(avg(f1) FILTER (support > 0 OR predicted > 0), 6) AS f1_macro,
  round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM per_class GROUP BY model, type)"""


def matrix(spark, d):
    return metrics.confusion(predictions(spark, d), CLASSES, ["model", "type"])


def results(spark, d):
    """One row per voter, staged because the comparisons use it more than once."""
    return stage(metrics.overall(matrix(spark, d), ["model", "type"]).drop("rows"), "results")


@query(f"WITH {PRED} SELECT model, y_true, y_pred, n FROM matrix")
def confusion_matrix(spark, d):
    return matrix(spark, d).drop("type")


@query(f"""WITH {PRED} SELECT model, y_true, y_pred, n, round(coalesce(n / nullif(sum(n)
  OVER (PARTITION BY model, y_true), 0), 0.0), 4) AS share FROM matrix""")
def confusion_matrix_norm(spark, d):
    return metrics.normalized_confusion(matrix(spark, d), ["model", "type"]).drop("type")


@query(f"""WITH {PRED} SELECT model, class, CAST(support AS BIGINT) AS support,
  round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM per_class""")
def per_class_metrics(spark, d):
    figures = metrics.per_class(matrix(spark, d), ["model", "type"])
    return figures.select("model", "class", "support",
                          *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")])


@query(f"WITH {PRED} SELECT model, accuracy, f1_macro, f1_weighted FROM results")
def classification_metrics(spark, d):
    return results(spark, d).drop("type")


@query(f"""WITH {PRED} SELECT model, class, CAST(support AS BIGINT) AS total,
  CAST(correct AS BIGINT) AS correct, CAST(support - correct AS BIGINT) AS errors,
  round(correct / support, 6) AS accuracy, round((support - correct) / support, 6) AS error_rate,
  coalesce((SELECT string_agg(y_pred || ':' || n, ',' ORDER BY y_pred) FROM matrix m
    WHERE m.model = p.model AND m.y_true = p.class AND m.y_pred <> p.class AND n > 0), '') AS wrong
FROM per_class p""")
def class_errors(spark, d):
    rows = metrics.class_errors(matrix(spark, d), ["model"])
    wrong = F.array_join(F.transform(F.map_entries("misclassified_as"), lambda e: F.concat(
        e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return rows.withColumn("wrong", wrong).drop("misclassified_as")


@query(f"""WITH {PRED}, w AS (SELECT model, y_true, y_pred, n, row_number() OVER (PARTITION BY model
    ORDER BY n DESC, y_true, y_pred) AS rn FROM matrix WHERE y_true <> y_pred AND n > 0),
  h AS (SELECT model, class, row_number() OVER (PARTITION BY model
    ORDER BY (support - correct) / support DESC, class) AS hard, row_number() OVER (PARTITION BY model
    ORDER BY (support - correct) / support, class) AS easy FROM per_class)
SELECT w.model, y_true AS confused_true, y_pred AS confused_as, n AS confused_n,
  a.class AS hardest_class, b.class AS best_class FROM w JOIN h a ON a.model = w.model AND a.hard = 1
  JOIN h b ON b.model = w.model AND b.easy = 1 WHERE rn = 1""")
def error_extremes(spark, d):
    return metrics.error_extremes(matrix(spark, d).drop("type"), ["model"])


@query(f"""WITH {PRED}, cells AS (SELECT model, y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL),
  listed AS (SELECT m.model, a.c AS y_true, b.c AS y_pred FROM models m
    CROSS JOIN (SELECT unnest(['de', 'en']) AS c) a CROSS JOIN (SELECT unnest(['de', 'en']) AS c) b)
SELECT model, y_true, y_pred, coalesce(n, 0) AS n FROM listed FULL JOIN cells USING (model, y_true, y_pred)""")
def confusion_unlisted(spark, d):
    """Two classes are listed; the rows of the others are counted all the same."""
    return metrics.confusion(predictions(spark, d), ("de", "en"), ["model"])


ROC = """points AS (SELECT model, c AS class, CASE c WHEN 'de' THEN prob_de WHEN 'en' THEN prob_en
    WHEN 'es' THEN prob_es ELSE prob_fr END AS score, y_true = c AS hit FROM pred, classes)"""


def points(spark, d):
    return metrics.one_vs_rest(predictions(spark, d), {c: f"prob_{c}" for c in CLASSES}, ["model"])


@query(f"""WITH {PRED}, {ROC},
  ranks AS (SELECT model, class, hit, rank() OVER (PARTITION BY model, class ORDER BY score)
    + (count(*) OVER (PARTITION BY model, class, score) - 1) / 2.0 AS r FROM points),
  s AS (SELECT model, class, sum(r) FILTER (hit) AS rs, count(*) FILTER (hit) AS p,
    count(*) FILTER (NOT hit) AS q FROM ranks GROUP BY ALL)
SELECT model, class, round((rs - p * (p + 1) / 2.0) / (p * q), 6) AS auc FROM s""")
def roc_auc(spark, d):
    return metrics.roc_auc(points(spark, d), ["model"])


@query(f"""WITH {PRED}, {ROC},
  ranks AS (SELECT model, class, hit, rank() OVER (PARTITION BY model, class ORDER BY score)
    + (count(*) OVER (PARTITION BY model, class, score) - 1) / 2.0 AS r FROM points),
  s AS (SELECT model, class, sum(r) FILTER (hit) AS rs, count(*) FILTER (hit) AS p,
    count(*) FILTER (NOT hit) AS q FROM ranks GROUP BY ALL)
SELECT model, round(avg(round((rs - p * (p + 1) / 2.0) / (p * q), 6)), 6) AS roc_auc FROM s GROUP BY model""")
def macro_roc_auc(spark, d):
    return metrics.macro_auc(metrics.roc_auc(points(spark, d), ["model"]), ["model"])


@query(f"""WITH {PRED}, {ROC},
  s AS (SELECT model, class, score, count(*) FILTER (hit) AS p, count(*) FILTER (NOT hit) AS q
    FROM points GROUP BY ALL)
SELECT model, class, round(score, 6) AS threshold,
  round(sum(p) OVER w / sum(p) OVER (PARTITION BY model, class), 6) AS tpr,
  round(sum(q) OVER w / sum(q) OVER (PARTITION BY model, class), 6) AS fpr
FROM s WINDOW w AS (PARTITION BY model, class ORDER BY score DESC)
UNION ALL SELECT DISTINCT model, class, NULL, 0.0, 0.0 FROM points""")
def roc_curve(spark, d):
    return metrics.roc_curve(points(spark, d), ["model"])


@query(f"""WITH {PRED} SELECT model, round(avg(confidence), 6) AS confidence_all,
  round(avg(confidence) FILTER (correct), 6) AS confidence_correct,
  round(avg(confidence) FILTER (NOT correct), 6) AS confidence_wrong FROM pred GROUP BY model""")
def confidence_by_correct(spark, d):
    return metrics.confidence_by_correct(predictions(spark, d), ["model"])


@query(f"""WITH {PRED} SELECT doc_id, model, y_true, y_pred, round(confidence, 6) AS confidence
FROM pred WHERE NOT correct ORDER BY pred.confidence DESC, doc_id, model LIMIT 10""")
def top_confident_errors(spark, d):
    return metrics.top_confident_errors(predictions(spark, d), 10, ["doc_id", "model"]).select(
        "doc_id", "model", "y_true", "y_pred", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {PRED}, wide AS (SELECT * FROM results)
SELECT model, 'overall' AS section, unnest(['accuracy', 'f1_macro', 'f1_weighted']) AS metric,
  unnest([accuracy, f1_macro, f1_weighted]) AS value FROM wide
UNION ALL SELECT model, 'class ' || class, unnest(['precision', 'recall', 'f1', 'support']),
  unnest([round(precision, 6), round(recall, 6), round(f1, 6), support::DOUBLE]) FROM per_class
UNION ALL SELECT model, 'cell ' || y_true || ' ' || y_pred, 'n', n::DOUBLE FROM matrix""")
def metrics_report(spark, d):
    return metrics.report(matrix(spark, d).drop("type"), ["model"])


@query(f"""WITH {PRED} SELECT model, type, accuracy, f1_macro, f1_weighted,
  CAST(row_number() OVER (ORDER BY f1_macro DESC, model) AS INTEGER) AS rank FROM results""")
def leaderboard(spark, d):
    every = results(spark, d)
    parts = [every.filter(F.col("type") == kind) for kind in ("Lexical", "Character", "Constant")]
    return compare.leaderboard(compare.collect_results(*parts), "f1_macro")


@query(f"""WITH {PRED}, r AS (SELECT *, row_number() OVER (PARTITION BY type
    ORDER BY accuracy DESC, model) AS rn FROM results)
SELECT type, model, accuracy, f1_macro, f1_weighted FROM r WHERE rn = 1""")
def best_per_group(spark, d):
    return compare.best_per_group(results(spark, d), "type", "accuracy")


@query(f"""WITH {PRED} SELECT type, count(*) AS models, """ + ", ".join(
    f"round({fn}({m}), 4) AS {m}_{n}" for m in ("accuracy", "f1_macro")
    for n, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max")))
       + " FROM results GROUP BY type")
def type_summary(spark, d):
    return compare.type_summary(results(spark, d), "type", ["accuracy", "f1_macro"])


@query(f"""WITH {PRED}, b AS (SELECT accuracy AS a, f1_macro AS f FROM results WHERE model = 'majority')
SELECT model, round((accuracy - a) * 100, 4) AS accuracy_points,
  round((accuracy - a) * 100 / a, 4) AS accuracy_relative_pct,
  round((f1_macro - f) * 100, 4) AS f1_macro_points,
  round((f1_macro - f) * 100 / f, 4) AS f1_macro_relative_pct FROM results, b""")
def baseline_delta(spark, d):
    return compare.baseline_delta(results(spark, d), "majority", ["accuracy", "f1_macro"])


@query("""WITH m AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_id
    FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))
SELECT doc_id, lang, label_id, lang AS decoded FROM documents JOIN m USING (lang)""")
def label_encode(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang")
    mapping = labels.label_mapping(docs, "lang")
    coded = labels.encode_labels(docs, "lang", mapping)
    names = mapping.withColumnRenamed("lang", "decoded")
    return labels.decode_labels(coded, "decoded", names, "label_id")
