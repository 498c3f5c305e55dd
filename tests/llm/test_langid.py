from __future__ import annotations

import zlib

import numpy as np

from chorus.llm import langid


def brute_phrases(sample: str, text: str, known: set[str]) -> int:
    count, i = 0, 0
    while i < len(text):
        n = 0
        while i + n < len(text) and text[i + n] in known and text[i:i + n + 1] in sample:
            n += 1
        i += max(n, 1)
        count += 1
    return count


def test_phrases_like_brute_force():
    sample = "the cat sat on the mat and the rat ran"
    model = langid.Model({"a": [sample], "b": ["un chat noir dort sur le tapis"]})
    for text in ("the cat ran on the mat", "zzz the zq cat", "rattatat", "q", "un rat noir", "ta" * 100):
        symbols = model.symbols([text])
        got = model.phrases(symbols)[0].tolist()
        blocks = [text[i:i + langid.BLOCK] for i in range(0, len(text), langid.BLOCK)]
        for k, own in enumerate((sample, "un chat noir dort sur le tapis")):
            assert got[k] == sum(brute_phrases(own, b, set(own)) for b in blocks)


def test_blocks_of_long_texts_add_up():
    model = langid.Model({"a": ["abcabcabd"]})
    text = "abcabd" * 500
    one = model.phrases(model.symbols([text]))[0, 0]
    parts = [text[i:i + langid.BLOCK] for i in range(0, len(text), langid.BLOCK)]
    assert one == model.phrases(model.symbols(parts)).sum()


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.languages(docs, langid.fit(docs)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_texts_without_language(frame, awkward, clashing):
    docs = frame(awkward + ["the cat sat on the mat"] * 30)
    model = langid.fit(docs)
    got = {r.doc_id: r.lang_pred for r in langid.languages(clashing(docs), model).collect()}
    for i, t in enumerate(awkward):
        assert (got[i] == "und") == (not any(c.isalpha() for c in t or ""))
    kept = langid.known_language(clashing(docs), model)
    assert kept.columns == clashing(docs).columns
    assert {r.doc_id for r in kept.collect()} <= {i for i, x in got.items() if x != "und"}


def test_prediction_uses_the_text_alone(frame):
    docs = frame(["le chat noir dort", "the black cat sleeps"] * 40)
    other = docs.selectExpr("doc_id + 1000 doc_id", "text", "'xx' lang", "'y' source", "0L n_chars")
    model = langid.fit(docs)
    a = [r.lang_pred for r in langid.languages(docs, model).orderBy("doc_id").collect()]
    b = [r.lang_pred for r in langid.languages(other, model).orderBy("doc_id").collect()]
    assert a == b


def test_nothing_to_learn(frame):
    docs = frame([])
    assert langid.languages(docs, langid.fit(docs)).count() == 0
    docs = frame(["some text"]).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert [r.lang_pred for r in langid.languages(docs, langid.fit(docs)).collect()] == ["und"]


def test_number_heavy_texts_stay_and_alien_texts_go(frame):
    rng = np.random.default_rng(6)
    clean = ["the cat sat on the mat and the rat ran over the old house"] * 30
    tables = ["\n".join(f"{n / 7:.3f}; {n}-{n % 12 + 1:02d}-01; +{n % 31}%" for n in range(k, k + 60))
              + f"\n{unit} total" for k, unit in ((100, "kg"), (900, "qx"), (5000, "zł"))]
    alien = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 400))) for _ in range(3)]
    docs = frame(clean + tables + alien)
    model = langid.fit(docs.filter("doc_id < 30"))
    assert all(len(t) > 400 for t in tables)
    kept = {r.doc_id for r in langid.known_language(docs, model).collect()}
    assert kept == set(range(33))


def test_a_shared_opening_does_not_fill_the_sample(frame, prose):
    """Texts that all open alike are learnt from their whole length."""
    opening = "shared notice in another tongue " * 20
    docs = frame([opening + prose(400, i) for i in range(60)])
    fitted = langid.fit(docs, rows=40, chars=300)
    text = prose(60, 999)
    plain = langid.Model({"en": [opening]})
    rate = lambda model: model.predict([text])[2][0]
    assert rate(fitted) < 0.8 * rate(plain)
