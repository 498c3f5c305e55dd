"""Scans and sinks: Parquet and CSV tables, declared schemas, split files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from chorus import schema
from chorus.workspace import apply_settings

CSV_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def load(spark: SparkSession, base: str, table: str) -> DataFrame:
    """Read one Parquet table of a data folder."""
    apply_settings(spark)
    return spark.read.parquet(f"{base.rstrip('/')}/{table}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for costly row work on a scan with too few splits.

    Large tables have far more splits than cores and pass unchanged; a small
    file with one row group is hash-partitioned on its key.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def documents(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    """The document table for text work: chosen columns, spread over the cores."""
    docs = load(spark, base, "documents")
    return spread(docs.select(*columns) if columns else docs, "doc_id")


def read_csv(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """CSV scan with a header and a declared schema (nothing is inferred).

    Quoted line ends stay in the text. An unquoted empty field is missing, a
    quoted one is the empty text: the marker for missing never occurs in files.
    """
    return spark.read.schema(columns).options(
        multiLine="true", nullValue="\u0000", **CSV_OPTIONS).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def create_tables(spark: SparkSession, base: str) -> dict[str, str]:
    """Create the three post tables as empty Parquet folders where absent."""
    paths = {}
    for name, columns in (("raw_posts", schema.RAW_POSTS),
                          ("processed_posts", schema.PROCESSED_POSTS),
                          ("collection_stats", schema.COLLECTION_STATS)):
        paths[name] = f"{base.rstrip('/')}/{name}"
        spark.createDataFrame([], columns).write.mode("ignore").parquet(paths[name])
    return paths


def read_table(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    return spark.read.schema(columns).parquet(path)


def export_posts(posts: DataFrame, source: str, columns: Sequence[str],
                 newest_first: Sequence[str]) -> DataFrame:
    """Posts of one source with a column list, newest first."""
    return (posts.filter(F.col("source") == source).select(*columns)
            .orderBy(*[F.desc(c) for c in newest_first]))


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split below ``path``; readers prune on ``split``."""
    df.write.partitionBy("split").parquet(path)
