"""The cleaning stage over a table of posts, and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chorus.functions import text as tx
from chorus.operators.rows import drop_where


def _with_steps(df: DataFrame, text: str, quotes: bool) -> tuple[DataFrame, list[str]]:
    """One column per step, each computed from the column before it."""
    out = df.withColumn("_entities", tx.decode_entities(F.coalesce(F.col(text), F.lit(""))))
    chain = [("_emoji", tx.remove_emoji), ("_mentions", tx.remove_mentions),
             ("_urls", tx.remove_urls), ("_spaces", tx.normalize_spaces)]
    if quotes:
        chain.append(("_quotes", tx.straighten_quotes))
    chain.append(("cleaned_text", tx.collapse_stops))
    names = ["_entities"]
    for name, step in chain:
        out = out.withColumn(name, step(F.col(names[-1])))
        names.append(name)
    return out, names[:-1]


def clean_dataset(df: DataFrame, text: str = "text", quotes: bool = False) -> DataFrame:
    """Add the cleaned text and its lengths; drop rows blank after cleaning."""
    steps, inner = _with_steps(df, text, quotes)
    cleaned = drop_where(steps.drop(*inner), "cleaned_text", F.trim("cleaned_text") == "")
    return cleaned.withColumns({
        "original_length": F.coalesce(F.length(text), F.lit(0)).cast("bigint"),
        "cleaned_length": F.length("cleaned_text").cast("bigint"),
    }).withColumn("length_reduction_pct",
                  tx.reduction_percent(F.col("original_length"), F.col("cleaned_length")))


def cleaning_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: how many texts each step changed, rows before and after."""
    steps, _ = _with_steps(df, text, False)
    kept = F.trim("cleaned_text") != ""
    reduction = tx.reduction_percent(F.length(text), F.length("cleaned_text"))
    return steps.agg(
        F.count(F.lit(1)).alias("initial_rows"),
        F.count_if(F.col("_entities") != F.col(text)).alias("html_entities_decoded"),
        F.count_if(tx.has_emoji(F.col("_entities"))).alias("emojis_found"),
        F.count_if(F.col("_mentions") != F.col("_emoji")).alias("mentions_removed"),
        F.count_if(F.col("_urls") != F.col("_mentions")).alias("urls_removed"),
        F.count_if(~kept).alias("empty_after_cleaning"),
        F.count_if(kept).alias("final_rows"),
        F.round(F.avg(F.when(kept, reduction)), 4).alias("avg_reduction_pct"))
