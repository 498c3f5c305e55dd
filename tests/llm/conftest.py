from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as extra columns of the input.
CLASHING = ("id", "fp", "words", "line", "key", "at", "row", "doc", "version", "t", "p", "rate",
            "kept", "spans", "tokens", "h", "first", "u", "v", "_stays")


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
            for _ in range(400)]


@pytest.fixture(scope="session")
def prose(words):
    def make(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(words) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def awkward(prose):
    """Texts with every awkward case: nulls, empty, long, equal, and odd characters."""
    base = prose(150, 1)
    return [None, "", " ", "\n\n", "word", base, base, base.replace(" ", "  "), base + " tail",
            prose(6000, 2), "  nbsp   wide", "日本語 の テキスト", "é" * 300,
            "<|endoftext|> a <|startoftext|>", "a\tb\x0bc\x0cd\r\ne", "don't  stop 's", "🙂 ok", "x" * 5000,
            prose(60, 3) + "\n" + prose(60, 4), prose(60, 4) + "\n" + prose(60, 3), "1 2 3", "...", "!" * 40]


def _frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from texts, with ids that may be missing or repeat."""
    return lambda texts, ids=None: _frame(spark, texts, ids)


@pytest.fixture(scope="session")
def clashing():
    """The same documents with extra columns of clashing names."""
    from pyspark.sql import functions as F

    return lambda df: df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])
