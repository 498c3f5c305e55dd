"""Language of a text: script rules and trigram profiles learnt from labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chorus.functions import scripts
from chorus.operators.rows import unfold
from chorus.workspace import stage

LETTERS = r"\p{L}+"
# Looks ahead of every character for three with a letter in the middle; never
# starts inside a surrogate pair.
TRIGRAM = r"(?s)(?![\x{dc00}-\x{dfff}])(?=(.\p{L}.))"


def classify(df: DataFrame, text: str, detected: Column) -> DataFrame:
    """Add ``language``; ``detected`` is the code used where scripts do not decide."""
    counts = scripts.script_counts(F.col(text))
    counted = df.withColumns({f"_{n}": c for n, c in counts.items() if n != "other"})
    by_script = scripts.language_by_script(F.col(text), F.col("_devanagari"), F.col("_english"),
                                           F.col("_total"))
    return counted.withColumn(
        "language", F.coalesce(by_script, scripts.language_from_code(detected))).drop(
        "_devanagari", "_english", "_total")


def trigrams(text: Column) -> Column:
    """Overlapping groups of three characters of the words, each between blanks."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")
    return F.regexp_extract_all(F.concat(F.lit(" "), words, F.lit(" ")), F.lit(TRIGRAM), F.lit(1))


def learn_profiles(labelled: DataFrame, text: str, label: str, classes: Sequence[str],
                   size: int | None = None) -> DataFrame:
    """Log probability of every trigram under each language.

    One row per trigram with one column per language; a trigram unseen in a
    language counts as one half. Words are counted first, so that only distinct
    words are cut into trigrams. With ``size`` only the most frequent trigrams of
    each language enter.
    """
    words = unfold(labelled, F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0)), "word",
                   label).groupBy(label, "word").agg(F.count(F.lit(1)).alias("n"))
    counts = (unfold(words, trigrams(F.col("word")), "gram", label, "n")
              .groupBy(label, "gram").agg(F.sum("n").alias("n")))
    if size is not None:
        place = Window.partitionBy(label).orderBy(F.desc("n"), "gram")
        counts = counts.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= size)
    best = stage(counts.select(label, "gram", "n"), "profiles")
    totals = best.agg(F.struct(*[
        F.coalesce(F.sum(F.when(F.col(label) == c, F.col("n"))), F.lit(0)).alias(c)
        for c in classes]).alias("t"))
    wide = best.groupBy("gram").pivot(label, list(classes)).agg(F.max("n"))
    share = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.5)) / (F.col(f"_t.{c}") + 1.0)
    return stage(wide.withColumn("_t", totals.scalar()).select(
        "gram", *[F.ln(share(c)).alias(f"lp_{c}") for c in classes]), "profile-weights")


def detect(df: DataFrame, id_col: str, text: str, profiles: DataFrame,
           classes: Sequence[str]) -> DataFrame:
    """Most probable language per text; null where no known trigram occurs.

    A trigram lies inside one word and the blanks around it, so each distinct
    word is scored once and the texts are joined with its score.
    """
    words = unfold(df, F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0)), "word",
                   id_col).groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))
    scored = unfold(words.select("word").distinct(), trigrams(F.col("word")), "gram", "word").join(
        profiles, "gram").groupBy("word").agg(*[F.sum(f"lp_{c}").alias(f"lp_{c}") for c in classes])
    sums = words.join(stage(scored, "word-scores"), "word").groupBy(id_col).agg(
        *[F.round(F.sum(F.col("n") * F.col(f"lp_{c}")), 3).alias(f"score_{c}") for c in classes])
    best = F.greatest(*[F.col(f"score_{c}") for c in classes])
    pick = F.coalesce(*[F.when(F.col(f"score_{c}") == best, c) for c in classes])
    return df.select(id_col).join(
        sums.withColumn("detected", pick), id_col, "left")
