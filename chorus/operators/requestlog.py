"""Statistics of a request log: latency, throughput, index percentiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chorus.operators.ordering import null_safe_join, order_statistics, value_counts
from chorus.workspace import stage


def index_position(percent: int) -> Column:
    """0-based place of a percentile without interpolation, in terms of ``n``."""
    return F.least(F.floor(F.col("n") * percent / F.lit(100)), F.col("n") - 1)


def index_percentiles(df: DataFrame, by: Sequence[str], value: str,
                      percents: Mapping[str, int]) -> DataFrame:
    """The value at the percentile's place in sorted order, per group."""
    return order_statistics(stage(value_counts(df, by, value), "value-counts"), by, value,
                            {name: index_position(p) for name, p in percents.items()})


def latency_stats(log: DataFrame, by: Sequence[str], latency: str, failed: Column,
                  ts: str) -> DataFrame:
    """Requests, failures, throughput and latency figures per load level.

    Latency figures cover successful requests; throughput is successes per
    second between the first and the last request of the level.
    """
    marked = log.withColumn("_ok", F.when(~failed, F.col(latency)))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    seconds = (micros(F.max(ts)) - micros(F.min(ts))) / F.lit(1e6)
    base = marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.count("_ok").alias("ok"),
        F.count_if(failed).alias("failed"),
        F.round(F.coalesce(F.try_divide(F.count("_ok"), seconds), F.lit(0.0)), 6).alias("throughput"),
        F.round(F.coalesce(F.try_divide(F.sum("_ok"), F.count("_ok")), F.lit(0.0)), 4).alias("mean"),
        F.min("_ok").alias("min"), F.max("_ok").alias("max"))
    n = F.col("n")
    counts = stage(value_counts(marked, by, "_ok"), "value-counts")
    places = order_statistics(counts, by, "_ok", {
        "_m1": F.floor((n - 1) / 2), "_m2": F.floor(n / 2),
        "p95": index_position(95), "p99": index_position(99)})
    return null_safe_join(base, places.drop("n"), by, "left").withColumn(
        "median", F.round((F.col("_m1") + F.col("_m2")) / 2, 4)).drop("_m1", "_m2")
