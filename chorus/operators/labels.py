"""Class names to ids and back, in alphabetical order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from chorus.workspace import stage


def label_mapping(df: DataFrame, label: str) -> DataFrame:
    """One row per class with its id 0..k-1; staged, so its size is known."""
    names = df.filter(F.col(label).isNotNull()).select(label).distinct()
    return stage(names.withColumn(
        "label_id", (F.row_number().over(Window.orderBy(label)) - 1).cast("int")), "labels")


def encode_labels(df: DataFrame, label: str, mapping: DataFrame) -> DataFrame:
    return df.join(mapping, label, "left")


def decode_labels(df: DataFrame, label: str, mapping: DataFrame, id_col: str) -> DataFrame:
    names = mapping.select(F.col("label_id").alias(id_col), label)
    return df.join(names, id_col, "left")
