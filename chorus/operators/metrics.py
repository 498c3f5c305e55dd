"""Evaluation of prediction tables: confusion, per-class figures, ROC, errors.

A prediction table holds the true and the predicted class of a row, optionally a
probability per class. Everything is grouped by the columns in ``by`` (a model,
a split), which may be empty. The rows are aggregated once, to one row per pair
of classes; every other figure is derived from that small frame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chorus.operators.ordering import null_safe_join, prefix_sums


def confusion(pred: DataFrame, classes: Sequence[str], by: Sequence[str] = (),
              truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """Counts for every pair of classes, zero where a pair does not occur.

    The rows are counted per pair first; the zero cells are filled in on the
    resulting handful of rows, without a join. Pairs with a class that is not in
    ``classes``, or with none, are added as they occur, so that no row is lost.
    """
    pairs = pred.groupBy(*by, F.col(truth).alias("_t"), F.col(guess).alias("_g")).agg(
        F.count(F.lit(1)).alias("_n"))
    cells = [(t, g, F.coalesce(F.sum(F.when(
        (F.col("_t") == t) & (F.col("_g") == g), F.col("_n"))), F.lit(0)).alias(f"_c{i}"))
        for i, (t, g) in enumerate((t, g) for t in classes for g in classes)]
    wide = pairs.groupBy(*by).agg(*[c for _, _, c in cells])
    listed = wide.select(*by, F.explode(F.array(*[
        F.struct(F.lit(t).alias("y_true"), F.lit(g).alias("y_pred"), F.col(f"_c{i}").alias("n"))
        for i, (t, g, _) in enumerate(cells)])).alias("cell")).select(*by, "cell.*")
    inside = F.col("_t").isin(*classes) & F.col("_g").isin(*classes)
    other = pairs.filter(~F.coalesce(inside, F.lit(False))).select(
        *by, F.col("_t").alias("y_true"), F.col("_g").alias("y_pred"), F.col("_n").alias("n"))
    return listed.unionByName(other)


def normalized_confusion(matrix: DataFrame, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Each cell as a share of its true class."""
    row = Window.partitionBy(*by, "y_true")
    return matrix.withColumn("share", F.round(F.coalesce(
        F.try_divide(F.col("n"), F.sum("n").over(row)), F.lit(0.0)), digits))


def _class_totals(matrix: DataFrame, by: Sequence[str]) -> DataFrame:
    """Support, predicted and correct rows per class."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sides = matrix.select(*by, F.explode(F.array(
        F.struct(F.col("y_true").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("correct")),
        F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("correct")),
    )).alias("s")).select(*by, "s.*")
    return sides.groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("correct").alias("correct"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def per_class(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 per class; zero where a figure is undefined."""
    c = F.col
    return _class_totals(matrix, by).select(
        *by, "class", "support", "predicted", "correct",
        _ratio(c("correct"), c("predicted")).alias("precision"),
        _ratio(c("correct"), c("support")).alias("recall"),
        _ratio(c("correct") * 2.0, c("support") + c("predicted")).alias("f1"))


def overall(matrix: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Accuracy, macro F1 and support-weighted F1.

    The macro mean covers the classes that occur as truth or as prediction.
    """
    c = F.col
    seen = F.when((c("support") > 0) | (c("predicted") > 0), c("f1"))
    return per_class(matrix, by).groupBy(*by).agg(
        F.sum("support").alias("rows"),
        F.round(_ratio(F.sum("correct"), F.sum("support")), digits).alias("accuracy"),
        F.round(F.avg(seen), digits).alias("f1_macro"),
        F.round(_ratio(F.sum(c("f1") * c("support")), F.sum("support")), digits).alias("f1_weighted"))


def class_errors(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, correct, errors and rates per true class, with the wrong guesses."""
    wrong = (F.col("y_true") != F.col("y_pred")) & (F.col("n") > 0)
    pairs = F.sort_array(F.collect_list(F.when(wrong, F.struct("y_pred", "n"))))
    totals = matrix.groupBy(*by, F.col("y_true").alias("class")).agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("correct"),
        pairs.alias("_p"))
    return totals.withColumns({
        "errors": F.col("total") - F.col("correct"),
        "accuracy": F.round(_ratio(F.col("correct"), F.col("total")), 6),
        "error_rate": F.round(_ratio(F.col("total") - F.col("correct"), F.col("total")), 6),
        "misclassified_as": F.map_from_entries("_p")}).drop("_p")


def error_extremes(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Most confused pair, hardest and best class; ties go to the first in class order."""
    wrong = F.when((F.col("y_true") != F.col("y_pred")) & (F.col("n") > 0),
                   F.struct((-F.col("n")).alias("m"), "y_true", "y_pred"))
    pair = matrix.groupBy(*by).agg(F.min(wrong).alias("_w"))
    rates = class_errors(matrix, by).filter(F.col("total") > 0).withColumn(
        "_rate", F.col("errors") / F.col("total")).groupBy(*by).agg(
        F.min(F.struct((-F.col("_rate")).alias("r"), "class"))["class"].alias("hardest_class"),
        F.min(F.struct(F.col("_rate").alias("r"), "class"))["class"].alias("best_class"))
    pair = pair.select(*by, F.col("_w.y_true").alias("confused_true"),
                       F.col("_w.y_pred").alias("confused_as"), (-F.col("_w.m")).alias("confused_n"))
    return null_safe_join(pair, rates, by) if by else pair.withColumn(
        "_r", rates.select(F.struct("hardest_class", "best_class")).scalar()).select(
        *pair.columns, "_r.hardest_class", "_r.best_class")


def one_vs_rest(pred: DataFrame, probabilities: Mapping[str, str], by: Sequence[str] = (),
                truth: str = "y_true") -> DataFrame:
    """Positives and negatives per group, class and distinct score.

    Rows without a score, or with NaN, count neither as positive nor as negative; a class
    that has no other rows keeps one row of zeros, so that its area is undefined.
    """
    rows = pred.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("class"), F.when(~F.isnan(p), F.col(p)).alias("score"),
                 (F.col(truth) == c).alias("hit")) for c, p in probabilities.items()
    ])).alias("r")).select(*by, "r.*")
    there = F.col("score").isNotNull()
    return rows.groupBy(*by, "class", "score").agg(
        F.count_if(there & F.col("hit")).alias("pos"), F.count_if(there & ~F.col("hit")).alias("neg"))


def _ranked(points: DataFrame, by: Sequence[str]) -> DataFrame:
    return prefix_sums(points, [*by, "class"], ["score"], ["pos", "neg"])


def roc_auc(points: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Area under the one-vs-rest ROC curve per class, null where undefined.

    Counts, per distinct score, the negatives below plus half of those equal.
    """
    wins = F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)
    return _ranked(points, by).groupBy(*by, "class").agg(
        F.round(F.try_divide(F.sum(wins), F.max(F.col("total_pos").cast("double"))
                             * F.max("total_neg")), digits).alias("auc"))


def macro_auc(auc: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Mean over the classes; null if it is undefined for one of them."""
    all_defined = F.count("auc") == F.count(F.lit(1))
    return auc.groupBy(*by).agg(F.round(F.when(all_defined, F.avg("auc")), digits).alias("roc_auc"))


def roc_curve(points: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """True and false positive rate at every distinct score, score and above.

    The curve starts at (0, 0), with no threshold, and ends at (1, 1).
    """
    rate = lambda w: F.round(F.try_divide(
        F.col(f"total_{w}") - F.col(f"before_{w}"), F.col(f"total_{w}")), digits)
    curve = _ranked(points.filter(F.col("score").isNotNull()), by).select(
        *by, "class", F.round("score", digits).alias("threshold"),
        rate("pos").alias("tpr"), rate("neg").alias("fpr"))
    start = points.select(*by, "class").distinct().withColumns({
        "threshold": F.lit(None).cast("double"), "tpr": F.lit(0.0), "fpr": F.lit(0.0)})
    return curve.unionByName(start)


def confidence_by_correct(pred: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    hit = F.col("correct")
    mean = lambda c: F.round(F.avg(c), digits)
    return pred.groupBy(*by).agg(
        mean(F.col("confidence")).alias("confidence_all"),
        mean(F.when(hit, F.col("confidence"))).alias("confidence_correct"),
        mean(F.when(~hit, F.col("confidence"))).alias("confidence_wrong"))


def top_confident_errors(pred: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """The wrong predictions the model was surest of."""
    return pred.filter(~F.col("correct")).orderBy(F.desc("confidence"), *order).limit(k)


def report(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All figures of a matrix as (section, metric, value) rows."""
    def rows(frame: DataFrame, section: Column, names: Sequence[str]) -> DataFrame:
        return frame.select(*by, section.alias("section"), F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.round(F.col(m).cast("double"), 6).alias("value"))
            for m in names])).alias("r")).select(*by, "section", "r.*")

    per = per_class(matrix, by)
    return (rows(overall(matrix, by), F.lit("overall"), ["accuracy", "f1_macro", "f1_weighted"])
            .unionByName(rows(per, F.concat(F.lit("class "), F.col("class")),
                              ["precision", "recall", "f1", "support"]))
            .unionByName(rows(matrix, F.concat_ws(" ", F.lit("cell"), "y_true", "y_pred"), ["n"])))
