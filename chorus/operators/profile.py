"""Counts, shares, cross-tabulations and numeric profiles of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chorus.operators.ordering import linear_percentiles, null_safe_join, value_counts
from chorus.workspace import stage


def count_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """Rows and percent of the total per value; missing values are left out."""
    counts = count_by(df.filter(F.col(key).isNotNull()), key)
    total = counts.agg(F.sum("n"))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / total.scalar(), digits))


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str]) -> DataFrame:
    """Counts with one column per listed value, zero where a pair is absent.

    Rows with another value, or none, count in the column ``other``.
    """
    counts = count_by(df, rows, columns)
    zero = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    listed = F.coalesce(F.col(columns).isin(*values), F.lit(False))
    return counts.groupBy(rows).agg(*[zero(F.col(columns) == v).alias(v) for v in values],
                                    zero(~listed).alias("other"))


def crosstab_percent(df: DataFrame, rows: str, columns: str, digits: int = 2) -> DataFrame:
    """Share of each pair in its row value, in long form."""
    counts = count_by(df, rows, columns)
    size = Window.partitionBy(rows)
    return counts.withColumn(
        "percent", F.round(F.col("n") * 100.0 / F.sum("n").over(size), digits))


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values per column, one row per column."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls"))
        for c in df.columns])).alias("r")).select("r.*")


def _present(value: str) -> Column:
    """The value, null if it is NaN."""
    return F.when(~F.isnan(F.col(value).cast("double")), F.col(value))


def numeric_summary(df: DataFrame, by: Sequence[str], value: str, digits: int = 4) -> DataFrame:
    """Size, mean, median and sample deviation per group; NaN counts as missing."""
    there = _present(value)
    base = df.groupBy(*by).agg(F.round(F.avg(there), digits).alias("mean"),
                               F.round(F.stddev_samp(there), digits).alias("std"))
    counts = stage(value_counts(df, by, value), "value-counts")
    middle = linear_percentiles(counts, by, value, {"median": 50})
    return null_safe_join(base, middle, by).withColumn("median", F.round("median", digits))


def month(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts of equal-width bins from the minimum to the maximum, all bins listed.

    The last bin is closed on the right. Missing values and NaN are in no bin.
    """
    spark, df = df.sparkSession, df.select(_present(value).alias(value))
    limits = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("r"))
    with_limits = df.filter(F.col(value).isNotNull()).withColumn("_r", limits.scalar())
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    place = F.floor(F.try_divide(F.col(value) - lo, hi - lo) * bins)
    counts = with_limits.groupBy(
        F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").withColumn("_r", limits.scalar()).select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"),
        (lo + (hi - lo) * F.col("bin") / bins).alias("low"))


def box_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 quartile ranges, and rows outside them."""
    counts = stage(value_counts(df, by, value), "value-counts")
    box = linear_percentiles(counts, by, value, {"q1": 25, "median": 50, "q3": 75})
    spread = F.col("q3") - F.col("q1")
    fences = stage(box.withColumns({"_low": F.col("q1") - 1.5 * spread,
                                    "_high": F.col("q3") + 1.5 * spread}), "fences")
    fenced = null_safe_join(counts.withColumnRenamed("n", "_n"), fences, by)
    kept = (F.col(value) >= F.col("_low")) & (F.col(value) <= F.col("_high"))
    return fenced.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(kept, F.col(value))).alias("whisker_low"),
        F.max(F.when(kept, F.col(value))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~kept, F.col("_n"))), F.lit(0)).alias("outliers"))


def binned_trend(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Mean of ``y`` over equal-width bins of ``x``: the trend of one on the other.

    Rows in which one of the two is missing or NaN take no part.
    """
    df = df.select(_present(x).alias(x), _present(y).alias(y))
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    limits = both.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("r"))
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    place = F.floor(F.try_divide((F.col(x) - lo).cast("double"), hi - lo) * bins)
    return (both.withColumn("_r", limits.scalar())
            .groupBy(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 4).alias("mean_x"),
                 F.round(F.avg(y), 6).alias("mean_y")))
