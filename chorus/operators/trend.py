"""Local linear regression from mergeable moments: the smooth trend of one column on another.

Rows fall into fine bins of ``x``; a bin keeps its size and the sums of x, y, x^2 and xy,
which are added before they are shuffled. Everything after that sees one row per bin. At
every point of a grid a line is fitted to the bins near it, weighted by the tricube of
their distance; how far "near" reaches follows from the share of rows a fit takes in. All
rows take part, and the finer the bins, the closer the result to that of the rows
themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chorus.workspace import stage

FINE = 2048


def _present(value: str) -> Column:
    """The value as a double, null if it is NaN."""
    v = F.col(value).cast("double")
    return F.when(~F.isnan(v), v)


def fine_moments(df: DataFrame, x: str, y: str, bins: int = FINE) -> DataFrame:
    """Per non-empty fine bin: size, mean of x and the sums of x, y, x^2 and xy; staged.

    Rows in which a value is missing or NaN take no part.
    """
    rows = df.select(_present(x).alias("x"), _present(y).alias("y"))
    rows = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    limits = rows.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("r"))
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    place = F.floor(F.try_divide(F.col("x") - lo, hi - lo) * bins)
    sums = (rows.withColumn("_r", limits.scalar())
            .groupBy(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
                 F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy")))
    return stage(sums.withColumn("mean", F.col("sx") / F.col("n")), "trend-moments")


def local_trend(df: DataFrame, x: str, y: str, points: int = 20, span: float = 2 / 3,
                bins: int = FINE) -> DataFrame:
    """(point, at, fitted) at ``points`` evenly spaced values of x, for x that varies.

    A fit takes in the nearest bins that hold the share ``span`` of all rows. Where all of
    its rows lie at one value of x, the fit is their mean.
    """
    moments = fine_moments(df, x, y, bins)
    ends = moments.agg(F.struct(F.min("mean").alias("lo"), F.max("mean").alias("hi"),
                                F.sum("n").alias("n")).alias("r"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    near = (moments.withColumn("_r", ends.scalar()).withColumn("point", grid)
            .withColumn("at", lo + (hi - lo) * F.col("point") / F.lit(max(points - 1, 1)))
            .withColumn("d", F.abs(F.col("mean") - F.col("at"))))
    # One point sees as many rows as there are bins.
    reached = F.sum("n").over(Window.partitionBy("point").orderBy("d", "bin")
                              .rowsBetween(Window.unboundedPreceding, -1))
    wanted = F.ceil(F.col("_r.n") * F.lit(float(span)))
    inside = near.withColumn("_in", F.coalesce(reached, F.lit(0)) < wanted)
    reach = F.max(F.when(F.col("_in"), F.col("d"))).over(Window.partitionBy("point"))
    share = F.least(F.coalesce(F.try_divide(F.col("d"), F.col("_h")), F.lit(0.0)), F.lit(1.0))
    cube = 1 - share * share * share
    weighted = (inside.withColumn("_h", reach * F.lit(1.0000001))
                .withColumn("w", F.when(F.col("_in"), cube * cube * cube).otherwise(0.0)))
    total = lambda c: F.sum(F.col("w") * F.col(c))
    sums = weighted.groupBy("point", "at").agg(
        total("n").alias("w"), total("sx").alias("x"), total("sy").alias("y"),
        total("sxx").alias("xx"), total("sxy").alias("xy"))
    mean_x, mean_y = F.col("x") / F.col("w"), F.col("y") / F.col("w")
    spread = F.col("xx") / F.col("w") - mean_x * mean_x
    slope = F.when(spread > 1e-12 * F.abs(F.col("xx") / F.col("w")),
                   (F.col("xy") / F.col("w") - mean_x * mean_y) / spread).otherwise(0.0)
    return sums.select("point", "at", (mean_y + slope * (F.col("at") - mean_x)).alias("fitted"))
