"""The data-engineering stages as one plan: clean, language, sentiment, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chorus.operators import cleaning, language, lexicon as lex
from chorus.operators.split import stratified_split
from chorus.workspace import stage


def clean_and_classify(posts: DataFrame, text: str, detected: Column) -> DataFrame:
    """Cleaned text, lengths and language class; blank rows dropped."""
    return language.classify(cleaning.clean_dataset(posts, text), "cleaned_text", detected)


def label_and_split(posts: DataFrame, id_col: str, text: str, detected: Column,
                    lexicon: DataFrame, seed: int = 42) -> DataFrame:
    """All stages up to train, validation and test rows, stratified by sentiment.

    The cleaned texts are staged, so that the costly expressions run once. Scores
    are short rows per text; they are staged too, as the split reads them more than
    once, and joined back by id.
    """
    cleaned = stage(clean_and_classify(posts, text, detected), "cleaned")
    scored = stage(lex.label_sentiment(cleaned, id_col, "cleaned_text", lexicon), "scores")
    return cleaned.join(stratified_split(scored, id_col, "sentiment", seed), id_col)
