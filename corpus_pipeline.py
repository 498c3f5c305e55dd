"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept: documents of no language go,
lines that an earlier document has go, one document of each near-duplicate group
stays, toxic documents go and poor ones are thinned, and the mixture is packed. All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chorus.llm import langid, lines, mixing, packing, simhash
from chorus.sources.tables import load
from chorus.workspace import stage

#: Good documents keep their tokens, poor ones are thinned and toxic ones go, whatever share of
#: the corpus they have: the targets are measured in the input of the stage.
MIXTURE = mixing.CLEANING


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; null, letterless and alien texts go."""
    return langid.known_language(docs, langid.fit(docs))


def unseen_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines no earlier document has; those left without a word go."""
    kept = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.filter(F.col("text").rlike("\\S"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say."""
    return mixing.mixed_documents(docs, load(spark, sf_dir, "labels"), MIXTURE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language", known_language),
    ("lines", unseen_lines),
    ("near duplicates", one_of_each),
    ("mixture", mixture),
    ("packing", packed),
]

#: Trained models, fingerprints by shingle hashes and token ids: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is staged as Parquet."""
    docs = load(spark, sf_dir, "documents")
    for i, (name, fn) in enumerate(STAGES):
        docs = fn(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
