"""Gradients of linear models, from their coefficients and the rows, as joins and aggregates.

They check a solver: at the optimum of a convex objective the gradient vanishes.
``weights`` has class, feature and weight; the feature ``size`` is the intercept, which
meets the constant 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chorus.plans import blocks
from chorus.workspace import stage


def _long(rows: DataFrame, id_col: str, size: int) -> DataFrame:
    """(id, feature, value) with the constant feature."""
    return blocks.long_form(rows, keep=[id_col]).unionByName(
        rows.select(id_col, F.lit(size).alias("feature"), F.lit(1.0).alias("value")))


def _scores(rows: DataFrame, long: DataFrame, id_col: str, label: str, weights: DataFrame,
            classes: int) -> DataFrame:
    """(id, class, own, score): every row with every class; ``own`` marks the class it has."""
    sums = long.join(weights, "feature").groupBy(id_col, "class").agg(
        F.sum(F.col("value") * F.col("weight")).alias("score"))
    every = rows.select(id_col, label, F.explode(F.array(*[F.lit(k) for k in range(classes)]))
                        .alias("class"))
    return every.join(sums, [id_col, "class"], "left").select(
        id_col, "class", (F.col(label).cast("int") == F.col("class")).alias("own"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def _norms(long: DataFrame, pulls: DataFrame, id_col: str, weights: DataFrame, held: Column) -> DataFrame:
    """Norm per class of ``held`` x weight less the sum of the rows times ``pull``."""
    sums = long.join(pulls, id_col).groupBy("class", "feature").agg(
        F.sum(F.col("value") * F.col("pull")).alias("pulled"))
    both = sums.join(weights, ["class", "feature"], "full").select(
        "class", "feature",
        (held * F.coalesce("weight", F.lit(0.0)) - F.coalesce("pulled", F.lit(0.0))).alias("g"))
    return both.groupBy("class").agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("norm"))


def squared_hinge_norms(rows: DataFrame, id_col: str, label: str, weights: DataFrame, size: int,
                        classes: int, c: float) -> DataFrame:
    """(class, norm) of the gradient of the squared hinge objective."""
    long = stage(_long(rows, id_col, size), "gradient-entries")
    scored = _scores(rows, long, id_col, label, weights, classes)
    sign = F.when(F.col("own"), 1.0).otherwise(-1.0)
    pull = 2 * c * sign * F.greatest(1 - sign * F.col("score"), F.lit(0.0))
    return _norms(long, scored.select(id_col, "class", pull.alias("pull")), id_col, weights, F.lit(1.0))


def softmax_norms(rows: DataFrame, id_col: str, label: str, weights: DataFrame, size: int,
                  classes: int, penalty: float) -> DataFrame:
    """(class, norm) of the gradient of the multinomial objective, a mean over the rows.

    The intercept is not penalised.
    """
    long = stage(_long(rows, id_col, size), "gradient-entries")
    scored = _scores(rows, long, id_col, label, weights, classes)
    row = Window.partitionBy(id_col)
    power = F.exp(F.col("score") - F.max("score").over(row))
    p = power / F.sum(power).over(row)
    pull = (F.col("own").cast("double") - p) / rows.agg(F.count(F.lit(1))).scalar()
    held = F.when(F.col("feature") == size, 0.0).otherwise(penalty)
    return _norms(long, scored.select(id_col, "class", pull.alias("pull")), id_col, weights, held)
