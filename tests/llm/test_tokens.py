from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

from chorus.llm import tokens

FILE = str(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_like_the_library_on_whole_texts(frame, awkward, clashing):
    texts = awkward * 2
    library = Tokenizer.from_file(FILE)
    want = sorted((i, len((t or "").encode()),
                   len(library.encode(t or "", add_special_tokens=False).ids))
                  for i, t in enumerate(texts))
    got = tokens.token_counts(clashing(frame(texts)), FILE).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_given_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    library = Tokenizer.from_file(FILE)
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids)
            for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, FILE).collect()} == want


def test_repeated_rows_missing_ids_and_empty_table(frame):
    got = tokens.token_counts(frame(["a b", "a b", "c"], [1, 1, None]), FILE).collect()
    assert sorted((repr(r.doc_id), r.n_tokens) for r in got) == [("1", 2), ("1", 2), ("None", 1)]
    assert tokens.token_counts(frame([]), FILE).count() == 0
    assert tokens.token_counts(frame([None]), FILE).collect()[0].n_tokens == 0
