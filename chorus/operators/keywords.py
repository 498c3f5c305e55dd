"""Keyword containment in texts and keyword frequencies per class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chorus.operators.rows import unfold
from chorus.wordlists import CATEGORY_KEYWORDS, CLASS_KEYWORDS


def found_keywords(lower_text: Column, keywords: Sequence[str]) -> Column:
    """The keywords contained in the text as substrings, in list order.

    One containment test per keyword inside the projection: no join, no pairs.
    """
    return F.array_compact(F.array(*[
        F.when(F.contains(lower_text, F.lit(k.lower())), k) for k in keywords]))


def keyword_hits(df: DataFrame, text: str,
                 lists: Mapping[str, Sequence[str]] = CLASS_KEYWORDS) -> DataFrame:
    """Add one array column per list with the keywords found."""
    lowered = df.withColumn("_lower", F.lower(text))
    return lowered.withColumns({
        name: found_keywords(F.col("_lower"), words) for name, words in lists.items()}).drop("_lower")


def keyword_frequency(df: DataFrame, text: str, label: str,
                      lists: Mapping[str, Sequence[str]] = CLASS_KEYWORDS) -> DataFrame:
    """Documents per class and keyword, each document counted once per keyword."""
    hits = keyword_hits(df.select(label, text), text, lists)
    every = unfold(hits, F.concat(*lists), "keyword", label)
    return every.groupBy(label, "keyword").agg(F.count(F.lit(1)).alias("n"))


def top_per_class(counts: DataFrame, label: str, item: str, n: str, k: int) -> DataFrame:
    """The ``k`` largest per class, ties in item order.

    Spark keeps only ``k`` rows per class and task before the shuffle.
    """
    order = Window.partitionBy(label).orderBy(F.desc(n), item)
    return (counts.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k))


def category_coverage(df: DataFrame, text: str,
                      lists: Mapping[str, Sequence[str]] = CATEGORY_KEYWORDS) -> DataFrame:
    """Texts that hold a keyword of each category, and hits of all its keywords."""
    hits = keyword_hits(df.select(text), text, lists)
    sizes = hits.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("category"), F.size(c).alias("hits")) for c in lists
    ])).alias("r")).select("r.*")
    return sizes.groupBy("category").agg(
        F.count_if(F.col("hits") > 0).alias("texts"), F.sum("hits").alias("hits"))


def sample_explanations(df: DataFrame, id_col: str, text: str, label: str,
                        lists: Mapping[str, Sequence[str]] = CLASS_KEYWORDS,
                        keywords: int = 5, shown: int = 100) -> DataFrame:
    """The first row of each class with the first keywords of that class."""
    first = df.groupBy(label).agg(F.min(id_col).alias(id_col)).select(id_col)
    hits = keyword_hits(df.join(first, id_col, "left_semi"), text, lists)
    own = F.coalesce(*[F.when(F.col(label) == name, F.col(name)) for name in lists])
    return hits.select(id_col, label, F.substring(text, 1, shown).alias("shown_text"),
                       F.slice(own, 1, keywords).alias("keywords"))
