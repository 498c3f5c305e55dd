"""Token counts without ids (operator 6).

The tokenizer cuts at white space before it looks for pieces, so the pre-token
counted here is the run of text between white space; a special string holds no
white space and lies inside one. Every distinct pre-token of the corpus goes
through the library once. Per-document frequencies then meet these counts:

* the head, pre-tokens with at least ``HEAD_SHARE`` of all occurrences, at most
  ``1 / HEAD_SHARE`` of them whatever the corpus, is broadcast, so the
  frequencies of common words are summed where the document is read;
* the tail is joined on the pre-token by shuffle; none of its keys is hot.

No id is kept. Defined results: a null text is empty, with no bytes and no
tokens; repeated rows are counted each; an empty table gives an empty result.
Columns other than id and text are not read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chorus.llm.common import stage, tuples, utf8

HEAD_SHARE = 5e-7
FLUSH = 300_000
LIMIT = 2048

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer for a file, loaded once per worker, as its defaults have it."""
    if path not in _LOADED:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def _frequencies(batches):
    """Occurrences of each pre-token of a task, in bounded parts."""
    def rows(counts):
        return pa.RecordBatch.from_pydict({
            "word": pa.array(list(counts), pa.binary()),
            "n": pa.array(list(counts.values()), pa.int64())})

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(text.split())
            if len(counts) >= FLUSH:
                yield rows(counts)
                counts = Counter()
    if counts:
        yield rows(counts)


def _pieces(path: str):
    def run(batch, _):
        words = [w.decode("utf-8") for w in batch.column(0).to_pylist()]
        encoded = tokenizer(path).encode_batch_fast(words, add_special_tokens=False)
        return {"word": batch.column(0), "n": batch.column(1),
                "pieces": [len(e.ids) for e in encoded]}
    return run


def vocabulary(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """Every distinct pre-token with its occurrences and its number of pieces, staged."""
    counts = (docs.select(utf8(text_col).alias("t")).mapInArrow(_frequencies, "word binary, n long")
              .groupBy("word").agg(F.sum("n").alias("n")))
    return stage(tuples(counts, _pieces(tokenizer_path), "word binary, n long, pieces long"),
                 "token-words")


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    words = vocabulary(docs, tokenizer_path, text_col)
    total = words.agg(F.sum("n")).first()[0] or 0
    head_rows = words.filter(F.col("n") >= max(1, total * HEAD_SHARE)).select("word", "pieces")
    head = docs.sparkSession.sparkContext.broadcast(
        {bytes(r[0]): r[1] for r in head_rows.toLocalIterator()})

    def split(batch, _):
        known = head.value
        keys, words_out, counts, ids, sizes = [], [], [], [], []
        for key, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or b""
            sure = 0
            for word, n in Counter(text.split()).items():
                pieces = known.get(word)
                if pieces is None:
                    keys.append(key)
                    words_out.append(word)
                    counts.append(n)
                    ids.append(None)
                    sizes.append(None)
                else:
                    sure += n * pieces
            keys.append(key)
            words_out.append(None)
            counts.append(sure)
            ids.append(doc)
            sizes.append(len(text))
        return {"key": keys, "word": words_out, "n": counts, "doc_id": ids, "n_bytes": sizes}

    rows = docs.select(F.monotonically_increasing_id().alias("key"),
                       F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t"))
    parts = stage(tuples(rows, split, "key long, word binary, n long, doc_id long, n_bytes long"),
                  "token-parts")
    tail = (parts.filter(F.col("word").isNotNull()).select("key", "word", "n")
            .join(words.select("word", "pieces"), "word")
            .select("key", (F.col("n") * F.col("pieces")).alias("n"),
                    F.lit(None).cast("long").alias("doc_id"),
                    F.lit(None).cast("long").alias("n_bytes")))
    known = parts.filter(F.col("word").isNull()).select("key", "n", "doc_id", "n_bytes")
    return (known.unionByName(tail).groupBy("key")
            .agg(F.sum("n").alias("n_tokens"), F.max("doc_id").alias("doc_id"),
                 F.max("n_bytes").alias("n_bytes"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
