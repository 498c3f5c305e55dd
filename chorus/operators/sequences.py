"""Word counts and fixed-length id sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chorus.functions import text as tx
from chorus.operators.ordering import dense_row_ids, value_counts
from chorus.operators.rows import unfold
from chorus.workspace import stage

PERCENTS = (50, 75, 90, 95, 99, 100)


def length_profile(df: DataFrame, text: str, limit: int) -> DataFrame:
    """Percentiles of the word count and the share of texts above ``limit``.

    Texts are first counted per length, so the percentile buffer holds one
    entry per distinct length and not one per text.
    """
    lengths = value_counts(df.select(tx.word_count(F.col(text)).alias("words")), [], "words")
    above = F.coalesce(F.sum(F.when(F.col("words") > limit, F.col("n"))), F.lit(0))
    profile = lengths.agg(
        F.sum("n").alias("total"), above.alias("above"),
        F.percentile("words", [p / 100 for p in PERCENTS], F.col("n")).alias("at"))
    return profile.select(
        F.col("total").alias("n"), "above",
        F.round(F.col("above") * 100.0 / F.col("total"), 4).alias("above_pct"),
        *[F.round(F.col("at")[i], 4).alias(f"p{p}") for i, p in enumerate(PERCENTS)])


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """All words with ids from 1, the most frequent first; ties in word order."""
    counts = (unfold(df, tx.tokens(F.col(text)), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    numbered = dense_row_ids(counts, [F.desc("n"), "word"], "id")
    return stage(numbered.select("word", F.col("id").cast("int").alias("id")), "vocabulary")


def save_dataset(encoded: DataFrame, vocab: DataFrame, path: str, split: str = "split") -> None:
    """Write an encoded dataset, a folder per split, with the vocabulary it was encoded by."""
    encoded.write.partitionBy(split).parquet(f"{path}/rows")
    vocab.write.parquet(f"{path}/vocabulary")


def load_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The encoded rows with their split, and the vocabulary."""
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/vocabulary")


def encode(df: DataFrame, id_col: str, text: str, vocab: DataFrame, length: int,
           unknown_id: int = 0) -> DataFrame:
    """Id sequence and attention mask of exactly ``length`` places per row."""
    words = df.select(id_col, F.posexplode_outer(
        F.slice(tx.tokens(F.col(text)), 1, length)).alias("pos", "word"))
    ids = (words.join(vocab, "word", "left")
           .groupBy(id_col).agg(F.sort_array(F.collect_list(F.when(
               F.col("word").isNotNull(),
               F.struct("pos", F.coalesce("id", F.lit(unknown_id)).alias("id"))))).alias("p"))
           .select(id_col, F.col("p.id").alias("ids")))
    return ids.select(id_col, tx.pad_sequence(F.col("ids"), length).alias("input_ids"),
                      tx.attention_mask(F.col("ids"), length).alias("attention_mask"))
