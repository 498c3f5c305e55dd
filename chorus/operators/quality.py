"""Checks on tables and on scoring requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chorus.config import RequestConfig
from chorus.functions.text import SPACES


def export_checks(exported: DataFrame, expected: int | Column, required: Sequence[str]) -> DataFrame:
    """Row count against the expected one, and missing values, as pass/fail rows."""
    counted = exported.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(F.col(c).isNull()).alias(c) for c in required])
    expected = expected if isinstance(expected, Column) else F.lit(expected)
    rows = counted.withColumn("_expected", expected.cast("bigint"))
    checks = [F.struct(F.lit("row_count").alias("check"), F.col("rows").alias("value"),
                       (F.col("rows") == F.col("_expected")).alias("passed"))]
    checks += [F.struct(F.lit(f"no_null_{c}").alias("check"), F.col(c).alias("value"),
                        (F.col(c) == 0).alias("passed")) for c in required]
    return rows.select(F.explode(F.array(*checks)).alias("r")).select("r.*")


def duplicate_keys(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Keys held by more than one row."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") > 1))


def validate_requests(requests: DataFrame, text: str = "text",
                      config: RequestConfig = RequestConfig()) -> DataFrame:
    """Add ``reason``: null for a valid request, else why it is refused."""
    body = F.col(text)
    blank = F.regexp_replace(body, f"[{SPACES}]+", "") == ""
    return requests.withColumn(
        "reason", F.when(body.isNull(), "missing").when(body == "", "empty")
        .when(F.length(body) > config.max_chars, "too long").when(blank, "blank"))


def valid_batches(batches: DataFrame, size: str, config: RequestConfig = RequestConfig()) -> Column:
    """Whether a batch holds an allowed number of texts."""
    return F.col(size).between(1, config.max_batch)
