"""Reproducible stratified splits and their quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chorus.operators.ordering import (HASH_DIGITS, bucket_offsets, hash_bucket, hash_key,
                                       null_safe_join)
from chorus.workspace import stage

CUTS = (("train", 80), ("val", 90))
LAST_SPLIT = "test"


def cut_keys(df: DataFrame, id_col: str, class_col: str, seed: int,
             cuts: Sequence[tuple[str, int]], digits: int = HASH_DIGITS) -> DataFrame:
    """Per class the hash key and id of the last row of each split.

    ``cuts`` holds cumulative whole percents. Only bucket counts are shuffled;
    rows are ranked in the few buckets that hold a cut.
    """
    keyed = df.select(id_col, class_col, hash_key(seed, F.col(id_col)).alias("_key"))
    keyed = keyed.withColumn("_bucket", hash_bucket(F.col("_key"), digits)).withColumn(
        "rows", F.lit(1))
    offsets = bucket_offsets(keyed, [class_col], "_bucket", ["rows"])
    limits = F.explode(F.array(*[
        F.struct(F.lit(name).alias("cut"),
                 F.floor(F.col("total_rows") * F.lit(percent) / F.lit(100)).alias("limit"))
        for name, percent in cuts]))
    edges = (offsets.withColumn("_c", limits)
             .filter((F.col("before_rows") < F.col("_c.limit"))
                     & (F.col("_c.limit") <= F.col("before_rows") + F.col("in_rows")))
             .select(class_col, "_bucket", F.col("_c.cut").alias("cut"),
                     (F.col("_c.limit") - F.col("before_rows")).alias("_at")))
    inside = Window.partitionBy(class_col, "_bucket", "cut").orderBy("_key", id_col)
    last = (null_safe_join(keyed, stage(edges, "split-edges"), [class_col, "_bucket"])
            .withColumn("_rank", F.row_number().over(inside))
            .filter(F.col("_rank") == F.col("_at")))
    return last.groupBy(class_col).agg(*[
        F.max(F.when(F.col("cut") == name, F.struct("_key", id_col))).alias(f"_to_{name}")
        for name, _ in cuts])


def stratified_split(df: DataFrame, id_col: str, class_col: str, seed: int = 42,
                     cuts: Sequence[tuple[str, int]] = CUTS,
                     rest: str = LAST_SPLIT) -> DataFrame:
    """Add ``split`` so that every class is divided in the same exact shares.

    The order inside a class is a hash of seed and id: the result does not
    depend on partitioning. The rows themselves are not shuffled, each is
    compared with the staged cut keys of its class.
    """
    edges = stage(cut_keys(df, id_col, class_col, seed, cuts), "split-cuts")
    me = F.struct(hash_key(seed, F.col(id_col)).alias("_key"), F.col(id_col))
    split: Column | None = None
    for name, _ in cuts:
        test = me <= F.col(f"_to_{name}")
        split = F.when(test, name) if split is None else split.when(test, name)
    joined = null_safe_join(df, edges, [class_col], "left")
    return joined.withColumn("split", split.otherwise(rest)).drop(
        *[f"_to_{name}" for name, _ in cuts])


def split_shares(df: DataFrame, class_col: str, split_col: str = "split") -> DataFrame:
    """Rows and percent of each class inside each split, and overall."""
    counts = df.groupBy(split_col, class_col).agg(F.count(F.lit(1)).alias("n"))
    overall = counts.groupBy(class_col).agg(F.sum("n").alias("n")).select(
        F.lit("all").alias(split_col), class_col, "n")
    both = counts.unionByName(overall)
    size = Window.partitionBy(split_col)
    return both.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(size), 4))


def split_quality(df: DataFrame, class_col: str, split_col: str = "split") -> DataFrame:
    """Largest distance of a class share in a split from its share overall."""
    shares = split_shares(df, class_col, split_col)
    base = shares.filter(F.col(split_col) == "all").select(
        class_col, F.col("percent").alias("_base"))
    parts = null_safe_join(shares.filter(F.col(split_col) != "all"), base, [class_col])
    return parts.groupBy(split_col).agg(
        F.sum("n").alias("n"),
        F.round(F.max(F.abs(F.col("percent") - F.col("_base"))), 4).alias("max_deviation"))
