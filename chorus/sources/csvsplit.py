"""CSV files with quoted line ends, read by many tasks.

A line end inside quotes belongs to a field, so a reader that starts in the middle of a
file cannot tell where a record begins. Whether a line starts a record depends only on
whether the number of quotes before it is even. Every split counts the quotes of its
lines on its own; the parities of the splits before it, a row per split, then say how it
began, and records are put together from their lines. A doubled quote counts twice and so
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from chorus.sources.tables import CSV_OPTIONS
from chorus.workspace import stage


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with file, start of their split, place in it and their number of quotes, staged."""
    text = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return stage(text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), "value", (quotes % 2).alias("odd")), "csv-lines")


def _records(lines: DataFrame) -> DataFrame:
    """(file, text) of every record; line ends inside quotes are kept."""
    splits = lines.groupBy("file", "split").agg((F.sum("odd") % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    began = splits.select("file", "split", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
                          .alias("began"))
    inside = Window.partitionBy("file", "split").orderBy("place")
    open_ = F.coalesce(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.join(began, ["file", "split"]).withColumn(
        "starts", ((F.col("began") + open_) % 2 == 0).cast("long"))
    counted = marked.withColumn("_own", F.sum("starts").over(
        inside.rowsBetween(Window.unboundedPreceding, 0)))
    totals = marked.groupBy("file", "split").agg(F.sum("starts").alias("_all"))
    offsets = totals.select("file", "split", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_past"))
    numbered = counted.join(offsets, ["file", "split"]).withColumn("record", F.col("_past") + F.col("_own"))
    parts = F.sort_array(F.collect_list(F.struct("split", "place", "value")))
    return (numbered.groupBy("file", "record").agg(parts.alias("parts"))
            .select("file", "record", F.array_join("parts.value", "\n").alias("text")))


def read_csv(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """As :func:`chorus.sources.tables.read_csv`, but a file is cut into splits.

    The rows of a file come in any order. The header, the first record of every file, and
    blank records are left out.
    """
    records = _records(_lines(spark, path)).filter(F.col("record") > 1)
    line = F.regexp_replace("text", "\r$", "")
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"} | {
        "nullValue": "\u0000", "multiLine": "true"}
    parsed = records.filter(line != "").select(
        F.from_csv(line, columns.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("r"))
    return parsed.select("r.*")
