"""TF-IDF as joins and aggregates, and its adapter to ML vectors.

Texts are hash-partitioned on their id once, before they are cut into n-grams
(which are several times larger). Counting terms per text, weighting and
normalising then happen inside those partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from chorus.config import TfidfConfig
from chorus.functions import text as tx
from chorus.operators.rows import place, unfold
from chorus.wordlists import STOP_WORDS
from chorus.workspace import stage

#: Counters of the n-grams that may be frequent, and how many are added up together.
SLOTS = 1 << 22
STRETCH = 1 << 16

#: Terms of a vocabulary that every task gets whole; in sessions that have broadcasts switched off, only a page.
LOOKUP_BYTES, LEAST_LOOKUP_BYTES = 8 << 20, 4 << 10


def _runs(df: DataFrame, id_col: str, text: str, longest: int, stop_words: Sequence[str],
          keep: Sequence[str] = ()) -> DataFrame:
    """One row per word with those after it: ``_1`` to ``_longest``, null past the end of the text."""
    words = df.select(id_col, *keep, tx.without(tx.tokens(F.col(text)), stop_words).alias("_w"))
    many = F.greatest(F.size("_w"), F.lit(1))
    shifted = [F.slice("_w", k, many).alias(f"_{k}") for k in range(1, longest + 1)]
    return words.select(id_col, *keep, F.inline_outer(F.arrays_zip(*shifted)).alias(
        *[f"_{k}" for k in range(1, longest + 1)]))


def _gram(length: int) -> Column:
    """The words of a run, joined by one space; null past the end of the text."""
    parts = [p for k in range(1, length + 1) for p in (F.lit(" "), F.col(f"_{k}"))]
    return F.concat(*parts[1:])


def terms(df: DataFrame, id_col: str, text: str, config: TfidfConfig = TfidfConfig(),
          stop_words: Sequence[str] = STOP_WORDS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per n-gram occurrence, partitioned on the text id."""
    placed = place(df.select(id_col, *keep, text), id_col, text)
    grams = F.array(*[_gram(k) for k in range(config.ngram_min, config.ngram_max + 1)])
    return unfold(_runs(placed, id_col, text, config.ngram_max, stop_words, keep), grams, "term",
                  id_col, *keep)


def _slot(length: int) -> Column:
    """The counter of a run of words; null past the end of the text."""
    hashed = F.xxhash64(*[F.col(f"_{k}") for k in range(1, length + 1)])
    return F.when(F.col(f"_{length}").isNotNull(), F.pmod(hashed, F.lit(SLOTS)).cast("int"))


def _large_slots(slots: DataFrame, least: int) -> DataFrame:
    """The counters of at least ``least`` entries; every column of ``slots`` has one a row, or null.

    A task adds its entries up in one array. The arrays are cut into stretches, which are
    added over the tasks.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(SLOTS, np.int64)
        for b in batches:
            for column in b.columns:
                np.add.at(found, column.drop_null().to_numpy(), 1)
        for at in range(0, SLOTS, STRETCH):
            if found[at:at + STRETCH].any():
                yield pa.RecordBatch.from_pydict({
                    "at": pa.array([at], pa.int32()), "n": pa.array([found[at:at + STRETCH].tobytes()])})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(n.as_buffer(), np.int64) for n in table["n"])
        return pa.table({"_slot": pa.array(np.flatnonzero(total >= least) + table["at"][0].as_py(), pa.int32())})

    return slots.mapInArrow(count, "at int, n binary").groupBy("at").applyInArrow(add, "_slot int")


def _in_large(df: DataFrame, large: DataFrame) -> DataFrame:
    """The rows whose counter ``_slot`` is among the large ones.

    These are sent to all tasks as bits, 64 a row: some 65,000 rows at most, whatever the text. By
    a measured size they would be shuffled in large tables, and every n-gram with them.
    """
    bits = stage(large.groupBy(F.shiftright("_slot", 6).alias("_at")).agg(
        F.bit_or(F.expr("shiftleft(1L, _slot & 63)")).alias("_bits")), "term-slots")
    return df.withColumn("_at", F.shiftright("_slot", 6)).join(F.broadcast(bits), "_at").filter(
        "shiftright(_bits, _slot & 63) & 1 = 1").drop("_at", "_bits")


def _frequent_terms(df: DataFrame, id_col: str, text: str, config: TfidfConfig,
                    stop_words: Sequence[str], least: int) -> DataFrame:
    """(id, term) of the n-grams longer than the shortest, with all that occur ``least`` times.

    Every n-gram is counted in one of ``SLOTS`` counters by its hash. A counter is never
    smaller than the number of any of its n-grams, so those in small ones are left out.
    """
    lengths = range(config.ngram_min + 1, config.ngram_max + 1)
    slots = [_slot(k) for k in lengths]
    runs = _runs(place(df.select(id_col, text), id_col, text), id_col, text, config.ngram_max, stop_words)
    large = _large_slots(runs.select(*[c.alias(f"_s{k}") for k, c in zip(lengths, slots)]), least)
    every = runs.select(id_col, *[f"_{k}" for k in range(1, config.ngram_max + 1)],
                        F.posexplode(F.array(*slots)).alias("_length", "_slot"))
    term = F.coalesce(*[F.when(F.col("_length") == at, _gram(k)) for at, k in enumerate(lengths)])
    return _in_large(every, large).select(id_col, term.alias("term"))


def vocabulary(df: DataFrame, id_col: str, text: str, config: TfidfConfig = TfidfConfig(),
               stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Terms by the document-frequency limits, the most frequent first, with ids from 0.

    Columns: term, df, total, n_docs, term_id (alphabetical). Ties at the cut go
    to the smaller term. The shortest terms are counted first: if there are enough, longer
    ones must occur as often as the last of them to enter.
    """
    n_docs = df.count()

    def limited(found: DataFrame) -> DataFrame:
        counts = found.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
        stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
        return stats.withColumn("n_docs", F.lit(n_docs).cast("bigint")).filter(
            (F.col("df") >= config.min_df) & (F.col("df") <= F.col("n_docs") * config.max_df))

    def most(stats: DataFrame) -> DataFrame:
        return stats.orderBy(F.desc("total"), "term").limit(config.max_features)

    top = most(limited(terms(df, id_col, text, replace(config, ngram_max=config.ngram_min), stop_words)))
    if config.ngram_max > config.ngram_min:
        top = stage(top, "terms-shortest")
        n, last = top.agg(F.count(F.lit(1)), F.min("total")).first()
        least = max(config.min_df, 1, last if n and n >= config.max_features else 0)
        longer = _frequent_terms(df, id_col, text, config, stop_words, least)
        top = most(top.unionByName(limited(longer)))
    return stage(top.withColumn("term_id", (F.row_number().over(Window.orderBy("term")) - 1)
                                .cast("int")), "tfidf-vocabulary")


def _raw_weights(df: DataFrame, id_col: str, text: str, vocab: DataFrame, config: TfidfConfig,
                 stop_words: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Weight before normalisation of every vocabulary term of every text, partitioned on the text.

    The staged vocabulary is joined before terms are counted, so only known
    terms are aggregated, by their numbers. Up to ``LOOKUP_BYTES`` of terms are sent to all
    tasks, so that no n-gram is shuffled to be looked up, unless the session wants no broadcasts.
    """
    size = vocab.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    off = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().startswith("-")
    sent = F.broadcast if size <= (LEAST_LOOKUP_BYTES if off else LOOKUP_BYTES) else lambda lookup: lookup
    known = terms(df, id_col, text, config, stop_words, keep).join(sent(vocab.select("term", "term_id")), "term")
    counts = known.groupBy(id_col, *keep, "term_id").agg(F.count(F.lit(1)).alias("tf"))
    idf = F.ln((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    weighed = vocab.select("term_id", "term", idf.alias("_idf"))
    return counts.join(sent(weighed), "term_id").withColumn("_raw", (F.ln("tf") + 1) * F.col("_idf"))


def weights(df: DataFrame, id_col: str, text: str, vocab: DataFrame,
            config: TfidfConfig = TfidfConfig(), stop_words: Sequence[str] = STOP_WORDS,
            keep: Sequence[str] = ()) -> DataFrame:
    """Normalised weight of every vocabulary term of every text, in long form."""
    raw = _raw_weights(df, id_col, text, vocab, config, stop_words, keep)
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, *keep, "term", "term_id", (F.col("_raw") / norm).alias("weight"))


def _as_vectors(size: int, id_columns: Sequence[str]):
    """Wrap index and value lists as sparse vectors, one Arrow batch at a time."""

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.num_rows
            vector = pa.StructArray.from_arrays(
                [pa.array([0] * rows, pa.int8()), pa.array([size] * rows, pa.int32()),
                 b.column("_i").cast(pa.list_(pa.int32())), b.column("_v")],
                names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in id_columns], vector], names=[*id_columns, "features"])

    return wrap


def vectors(df: DataFrame, id_col: str, text: str, vocab: DataFrame, size: int,
            config: TfidfConfig = TfidfConfig(), stop_words: Sequence[str] = STOP_WORDS,
            keep: Sequence[str] = ()) -> DataFrame:
    """``(id, kept columns, features)``, one sparse vector per text; without terms it is zero."""
    long = weights(df, id_col, text, vocab, config, stop_words)
    lists = long.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("term_id", "weight"))).alias("_p"))
    names = [id_col, *keep]
    every = df.select(*names).join(lists, id_col, "left").select(
        *names,
        F.coalesce(F.col("_p.term_id"), F.array().cast("array<int>")).alias("_i"),
        F.coalesce(F.col("_p.weight"), F.array().cast("array<double>")).alias("_v"))
    columns = T.StructType([*[df.schema[n] for n in names], T.StructField("features", VectorUDT())])
    return every.mapInArrow(_as_vectors(size, names), columns)


def class_log_probabilities(long: DataFrame, label: str, classes: Sequence[str],
                            vocab: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Smoothed log probability of each term under each class (multinomial)."""
    sums = long.groupBy(label, "term").agg(F.sum("weight").alias("w"))
    grid = vocab.select("term", F.explode(F.array(*[F.lit(c) for c in classes])).alias(label))
    full = grid.join(sums, [label, "term"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    mass = Window.partitionBy(label)
    return full.select(label, "term", F.ln(
        (F.col("w") + alpha) / F.sum(F.col("w") + alpha).over(mass)).alias("log_prob"))


def predicted_classes(long: DataFrame, id_col: str, label: str, probabilities: DataFrame,
                      priors: DataFrame) -> DataFrame:
    """(id, label): the class a multinomial naive Bayes model gives each text with a known term.

    ``probabilities`` has label, term, log_prob and ``priors`` label, log_prior; equal
    scores go to the smaller class.
    """
    scored = (long.select(id_col, "term", "weight").join(probabilities, "term")
              .groupBy(id_col, label).agg(F.sum(F.col("weight") * F.col("log_prob")).alias("_s"))
              .join(priors, label).withColumn("_s", F.round(F.col("_s") + F.col("log_prior"), 9)))
    top = scored.groupBy(id_col).agg(F.max("_s").alias("_top"))
    return (scored.join(top, id_col).filter(F.col("_s") == F.col("_top"))
            .groupBy(id_col).agg(F.min(label).alias(label)))


def contributions(long: DataFrame, id_col: str, label: str, coefficients: DataFrame,
                  texts: int, threshold: float = 0.05) -> DataFrame:
    """Share of each term in the score of a text's class, above a threshold.

    For a linear model this is coefficient x (weight - mean weight); the mean is
    over all ``texts``, absent terms counting as zero.
    """
    means = long.groupBy("term").agg((F.sum("weight") / texts).alias("_mean"))
    joined = (long.join(coefficients, [label, "term"])
              .join(stage(means, "term-means"), "term"))
    shared = joined.withColumn("contribution", F.col("coefficient") * (
        F.col("weight") - F.col("_mean")))
    return shared.filter(F.col("contribution") > threshold).select(
        id_col, label, "term", "contribution")
