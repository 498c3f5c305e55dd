"""Ranks, prefix sums and order statistics that never gather a group in one task.

A window over a class, a source or the whole table sorts that group in a single
task, which fails once the group holds a large share of the data. Here every
such operator works on two levels. Rows fall into parts that follow the sort
order; the totals of the parts are a small aggregate (combined before the
shuffle) whose prefix sums give each part its offset; a window is only used
inside one part. Parts are cut where the data is: by the leading digits of a
hash, which are even by construction, or by the range partitioner, which splits
a hot group or a hot value range over many tasks. The results are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from chorus.workspace import stage

HASH_DIGITS = 4


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; keeps the left key columns."""
    if not on:
        raise ValueError("a join needs at least one key")
    renamed = reduce(lambda d, c: d.withColumnRenamed(c, f"_r_{c}"), on, right)
    condition = reduce(lambda a, b: a & b,
                       [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_r_{c}" for c in on])


def hash_key(seed: int, key: Column) -> Column:
    """Repeatable pseudo-random sort key of a row, 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_bucket(key: Column, digits: int = HASH_DIGITS) -> Column:
    """Leading digits of a hash key: even buckets in the order of the key."""
    return F.substring(key, 1, digits)


def value_bucket(value: Column, scale: int = 1024) -> Column:
    """Bucket of a number, rising with it; finer near zero."""
    v = value.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * F.lit(scale)).cast("bigint")


def bucket_offsets(df: DataFrame, by: Sequence[str], bucket: str,
                   weights: Sequence[str]) -> DataFrame:
    """Per group and bucket: sum of each weight, sum before it, group total."""
    sums = df.groupBy(*by, bucket).agg(*[F.sum(w).alias(f"in_{w}") for w in weights])
    whole = Window.partitionBy(*by)
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    cols = [c for w in weights for c in (
        F.col(f"in_{w}"),
        F.coalesce(F.sum(f"in_{w}").over(before), F.lit(0)).alias(f"before_{w}"),
        F.sum(f"in_{w}").over(whole).alias(f"total_{w}"))]
    return sums.select(*by, bucket, *cols)


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence[str],
                weights: Sequence[str], until: Mapping[str, int] | None = None) -> DataFrame:
    """Add ``before_<w>`` (sum over earlier rows) and ``total_<w>`` per weight.

    ``order`` must be a total order inside a group. The frame is range-sorted
    and staged with its partition number, so that a group of any size is cut
    into equal parts. With ``until`` = {weight: limit} only rows whose sum before
    them is below the limit are kept; parts past the limit leave unsorted.
    """
    parts = stage(df.orderBy(*by, *order).withColumn("_part", F.spark_partition_id()), "sorted")
    offsets = bucket_offsets(parts, by, "_part", weights).drop(*[f"in_{w}" for w in weights])
    for w, limit in (until or {}).items():
        offsets = offsets.filter(F.col(f"before_{w}") < limit)
    joined = null_safe_join(parts, stage(offsets, "offsets"), [*by, "_part"])
    inside = (Window.partitionBy(*by, "_part").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    result = joined.withColumns({
        f"before_{w}": F.col(f"before_{w}") + F.coalesce(F.sum(w).over(inside), F.lit(0))
        for w in weights})
    for w, limit in (until or {}).items():
        result = result.filter(F.col(f"before_{w}") < limit)
    return result.drop("_part")


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows ``n`` per group and value; the entries for missing values and NaN count none.

    Missing values are not filtered out first: the filter would move below the
    projection that computes the value and compute it twice.
    """
    there = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return df.groupBy(*by, value).agg(F.count(there).alias("n"))


def order_statistics(counts: DataFrame, by: Sequence[str], value: str,
                     positions: Mapping[str, Column]) -> DataFrame:
    """Exact values at sorted positions, one row per group, with its size ``n``.

    ``counts`` comes from :func:`value_counts`. ``positions`` maps an output
    column to a 0-based position written in terms of ``n``, the number of
    values of the group. Bucket counts find the narrow ranges of values the
    positions fall in; only the values of those ranges are sorted.
    """
    points = counts.withColumn("_bucket", value_bucket(F.col(value)))
    offsets = bucket_offsets(points, by, "_bucket", ["n"])
    places = offsets.withColumn("n", F.col("total_n")).select(
        *by, "_bucket", "before_n", "in_n", F.col("n").alias("_size"),
        *[pos.cast("bigint").alias(f"_at_{name}") for name, pos in positions.items()])

    def between(name: str, low: Column, high: Column) -> Column:
        return (F.col(f"_at_{name}") >= low) & (F.col(f"_at_{name}") < high)

    here = reduce(lambda a, b: a | b, [
        between(name, F.col("before_n"), F.col("before_n") + F.col("in_n")) for name in positions])
    near = stage(places.filter(here).withColumnRenamed("before_n", "_start"), "places")
    candidates = null_safe_join(points, near, [*by, "_bucket"])
    ranked = prefix_sums(candidates, [*by, "_bucket"], [value], ["n"]).withColumn(
        "_from", F.col("_start") + F.col("before_n"))
    return ranked.groupBy(*by).agg(F.max("_size").alias("n"), *[
        F.max(F.when(between(name, F.col("_from"), F.col("_from") + F.col("n")),
                     F.col(value))).alias(name) for name in positions])


def linear_percentiles(counts: DataFrame, by: Sequence[str], value: str,
                       percents: Mapping[str, float]) -> DataFrame:
    """Percentiles with linear interpolation between neighbours, per group."""
    n = F.col("n")
    positions: dict[str, Column] = {}
    for name, p in percents.items():
        at = (n - 1) * F.lit(p / 100.0)
        positions[f"_{name}_lo"] = F.floor(at)
        positions[f"_{name}_hi"] = F.ceil(at)
    stats = order_statistics(counts, by, value, positions)
    cols = []
    for name, p in percents.items():
        at = (n - 1) * F.lit(p / 100.0)
        lo, hi = F.col(f"_{name}_lo").cast("double"), F.col(f"_{name}_hi").cast("double")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return stats.select(*by, "n", *cols)


def hashed_sample(df: DataFrame, n: int, key: str, seed: int,
                  digits: int = HASH_DIGITS) -> DataFrame:
    """Exactly ``n`` rows, repeatable and independent of the partitioning.

    Bucket counts find how far into the hash order the sample reaches, so only
    about ``n`` rows are sorted.
    """
    keyed = df.withColumn("_key", hash_key(seed, F.col(key)))
    bucketed = keyed.select(hash_bucket(F.col("_key"), digits).alias("_bucket"),
                            F.lit(1).alias("rows"))
    offsets = bucket_offsets(bucketed, [], "_bucket", ["rows"])
    last = offsets.filter(F.col("before_rows") < n).agg(F.max("_bucket"))
    return (keyed.filter(hash_bucket(F.col("_key"), digits) <= last.scalar())
            .orderBy("_key", key).limit(n).drop("_key"))


def dense_row_ids(df: DataFrame, order: Sequence[str | Column], name: str = "row_id") -> DataFrame:
    """Consecutive ids 1..n in a total order, without a one-task window.

    The frame is sorted by range partitioning and staged with its partition
    number; row counts per partition then give each partition its offset.
    """
    ordered = df.orderBy(*order).withColumns({
        "_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    local = ordered.withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    staged = stage(local, "row-ids")
    counts = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"))
    offsets = counts.select("_part", F.coalesce(
        F.sum("rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_offset"))
    return (staged.join(stage(offsets, "row-id-offsets"), "_part")
            .withColumn(name, F.col("_offset") + F.col("_at") + 1)
            .drop("_part", "_at", "_offset"))
