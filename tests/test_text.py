from __future__ import annotations

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from chorus.functions import scores, scripts, text as tx
from chorus.operators import cleaning, language

CLEANING = [
    ("&#39;Tis &amp; so &lt;b&gt;", "'Tis & so <b>"),
    ("hi @user_1-x there", "hi there"),
    ("see https://a.b/c?d=%20e#frag end", "see #frag end"),
    ("WWW.x.com www.x.com/a~b", "WWW.x.com ~b"),
    ("what?!?! wait...  ok", "what! wait. ok"),
    ("mail a@b.com now", "mail a.com now"),
    ("  \t spaced out  ", "spaced out"),
    ("ok 😀👍🏽 1️⃣ 🇮🇳 ❤️ done", "ok done"),
    ("“curly” ‘quotes’", "“curly” ‘quotes’"),
    ("HTTP://A.B stays", "HTTP://A.B stays"),
    ("https://y.com/@chan/v x", "x"),
    ("@only 😀 http://x.y", ""),
    (None, ""),
]

LANGUAGES = [
    ("ok", "Unknown"), ("   ab ", "Unknown"), ("good jobs here", "English"),
    ("नौकरी चाहिए", "Hindi"), ("नौकरी job chahiye", "Code-Mixed"), ("abcd1", "English"),
    ("abc12", None), ("12345 67890", None), ("été déjà là", None), (None, "Unknown"),
]


def test_cleaning_cases(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEANING)], "id int, text string")
    got = dict(rows.select("id", tx.clean_text(F.col("text"))).collect())
    assert got == {i: want for i, (_, want) in enumerate(CLEANING)}


def test_blank_rows_leave_and_are_counted(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEANING)], "id int, text string")
    assert cleaning.clean_dataset(rows).count() == len(CLEANING) - 2
    stats = cleaning.cleaning_stats(rows).first()
    assert (stats.initial_rows, stats.empty_after_cleaning, stats.final_rows) == (13, 2, 11)


def test_quotes_only_on_request(spark):
    row = spark.createDataFrame([("“so” ‘it’",)], "text string")
    assert row.select(tx.clean_text(F.col("text"), quotes=True)).first()[0] == "\"so\" 'it'"


def test_cleaning_follows_python(spark):
    """Random texts through the same steps with Python's re and html modules."""
    rng = random.Random(5)
    pieces = ["word", " ", "  ", "\t", "\n", " ", "\x85", "&amp;", "&#x41;", "&nbsp", "@नाम_1",
              "http://a.b/c", "www.x.y", "!?", "...", "é", "ñ", "#tag", "&copy", "　", "-"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(400)]

    def python(t):
        t = html.unescape(t)
        t = re.sub(r"@[\w\-]+", "", t)
        t = re.sub(r"https?://[a-z!$-_]+", "", t)
        t = re.sub(r"www\.[a-z!$-_]+", "", t)
        t = re.sub(r"\s+", " ", t).strip()
        return re.sub(r"([!?.]){2,}", r"\1", t)

    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = dict(rows.select("id", tx.clean_text(F.col("text"))).collect())
    # Copyright sign is a pictograph of the emoji block only from U+2600 on.
    assert got == {i: python(t) for i, t in enumerate(texts)}
    counts = dict(rows.select("id", tx.word_count(F.col("text"))).collect())
    assert counts == {i: len(t.split()) for i, t in enumerate(texts)}


def test_long_link_does_not_overflow(spark):
    row = spark.createDataFrame([("x https://a.b/" + "c" * 50_000 + " y",)], "text string")
    assert row.select(tx.clean_text(F.col("text"))).first()[0] == "x y"


def test_language_cases(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LANGUAGES)], "id int, text string")
    text = F.col("text")
    c = scripts.script_counts(text)
    got = dict(rows.select("id", scripts.language_by_script(
        text, c["devanagari"], c["english"], c["total"])).collect())
    assert got == {i: want for i, (_, want) in enumerate(LANGUAGES)}


@pytest.mark.parametrize("code, want", [("hi", "Hindi"), ("en", "English"), ("fr", "Code-Mixed"),
                                        (None, "Code-Mixed")])
def test_fallback_classes(spark, code, want):
    row = spark.createDataFrame([("abc12", code)], "text string, code string")
    assert language.classify(row, "text", F.col("code")).first()["language"] == want


def test_trigrams_cover_the_words_and_keep_surrogates_whole(spark):
    rows = spark.createDataFrame([("Ab, c",), ("𝒜b",), ("1 2",)], "text string")
    assert [r[0] for r in rows.select(language.trigrams(F.col("text"))).collect()] == [
        [" ab", "ab ", " c "], [" 𝒜b", "𝒜b "], []]


def test_profiles_learn_the_trigrams_of_the_texts(spark):
    rows = spark.createDataFrame([("en", "the then, the"), ("fr", "les le")], "lang string, t string")
    profiles = language.learn_profiles(rows, "t", "lang", ["en", "fr"], size=50)
    from collections import Counter
    grams = {(r.lang, g) for r in rows.select("lang", language.trigrams(F.col("t")).alias("g")).collect()
             for g in r.g}
    assert {r.gram for r in profiles.collect()} == {g for _, g in grams}
    counts = Counter(g for r in rows.filter("lang = 'en'").select(
        language.trigrams(F.col("t")).alias("g")).collect() for g in r.g)
    import math
    the = profiles.filter("gram = 'the'").first()
    assert abs(the.lp_en - math.log(counts["the"] / (sum(counts.values()) + 1))) < 1e-12
    assert language.detect(rows.withColumn("id", F.monotonically_increasing_id()), "id", "t",
                           profiles, ["en", "fr"]).filter("detected is null").count() == 0


@pytest.mark.parametrize("words, n", [([], 0), (["a"], 1), (["a", "b"], 3), (["a", "b", "c"], 6),
                                      (["a", "b", "a", "b"], 9)])
def test_ngrams(spark, words, n):
    row = spark.createDataFrame([(words,)], "w array<string>")
    grams = row.select(tx.ngrams(F.col("w"))).first()[0]
    want = [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    assert grams == want and len(grams) == n


def test_padding_and_mask(spark):
    row = spark.createDataFrame([([5, 6],), ([1, 2, 3, 4, 5],), ([],)], "ids array<int>")
    got = [tuple(r) for r in row.select(tx.pad_sequence(F.col("ids"), 4),
                                        tx.attention_mask(F.col("ids"), 4)).collect()]
    assert got == [([5, 6, 0, 0], [1, 1, 0, 0]), ([1, 2, 3, 4], [1, 1, 1, 1]),
                   ([0, 0, 0, 0], [0, 0, 0, 0])]


def test_sentiment_thresholds(spark):
    rows = spark.createDataFrame([(0.05,), (-0.05,), (0.0499,), (-0.0499,)], "c double")
    assert [r[0] for r in rows.select(scores.sentiment_class(F.col("c"))).collect()] == [
        "Positive", "Negative", "Neutral", "Neutral"]


def test_softmax_and_confidence(spark):
    row = spark.createDataFrame([([1.0, 3.0, 2.0],)], "s array<double>")
    p = scores.softmax(F.col("s"))
    got = row.select(p.alias("p"), scores.argmax(F.col("s")).alias("k"),
                     scores.confidence_map(["a", "b", "c"], p).alias("m")).first()
    assert abs(sum(got.p) - 1) < 1e-12 and got.k == 1
    assert got.m == {"a": 0.09, "b": 0.6652, "c": 0.2447}


def test_emoji_names(spark):
    row = spark.createDataFrame([("hi 😀 there",), ("no",)], "t string")
    assert [r[0] for r in row.select(tx.name_emoji(F.col("t"))).collect()] == [
        "hi :grinning_face: there", "no"]


def test_entities_like_the_standard_library(spark):
    import html.entities

    rng = random.Random(1)
    names = list(html.entities.html5)
    texts = ["a &amp; b", "&notit;", "&#65;&#x41;&#X41", "&#128;&#150;&#0;&#13;&#11;&#1114112;&#xD800;",
             "&#99999999999999;&", "&&amp;;", "&;", "&unknown;", "&amp,foo &ltx", "&copy2024", "&#;&#x;",
             "&eacute&Eacute;\n&amp\n", "&#xFFFF;&#64976;", "&fjlig;"]
    kinds = [lambda: "&" + rng.choice(names), lambda: "&" + rng.choice(names).rstrip(";") + "x",
             lambda: f"&#{rng.randint(0, 70000)};", lambda: f"&#x{rng.randint(0, 0x120000):x}",
             lambda: rng.choice(" z&é;")]
    texts += ["".join(rng.choice(kinds)() for _ in range(8)) for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", tx.decode_entities(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in got} == {t: html.unescape(t) for t in texts}
