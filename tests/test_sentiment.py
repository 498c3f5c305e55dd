"""The rules of context, against a word-by-word loop and figures by hand."""

from __future__ import annotations

import re

import pytest

from chorus.operators import lexicon as lex
from chorus.wordlists import BOOSTERS, DAMPENERS, NEGATIONS

WORDS = {"good": (190, 60), "bad": (-250, 67), "great": (310, 75), "plain": (0, 10), "very": (0, 30)}


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w, v, s) for w, (v, s) in WORDS.items()],
                                 "word string, valence bigint, subjectivity bigint")


def loud(word):
    return bool(re.fullmatch(r"[A-Z0-9_]+", word) and re.search("[A-Z]", word))


def brute(text):
    """(compound, positive, negative, neutral, polarity, subjectivity), one word after the other."""
    tokens = re.findall(r"[\w]{2,}", text or "")
    mixed = 0 < sum(map(loud, tokens)) < len(tokens)
    low = [t.lower() for t in tokens]
    but = low.index("but") if "but" in low else None
    felt, polar, subjective = [], [], []
    for i, token in enumerate(tokens):
        v, s = WORDS.get(low[i], (None, None))
        sign = 0 if not v else 1 if v > 0 else -1
        x = (v or 0) / 100
        if mixed and loud(token):
            x += sign * 0.733
        before = range(i - 1, max(i - 4, -1), -1)
        for distance, j in enumerate(before):
            kind = (low[j] in BOOSTERS) - (low[j] in DAMPENERS)
            strength = 0.293 + (0.733 if mixed and loud(tokens[j]) else 0)
            x += sign * kind * strength * (1, 0.95, 0.9)[distance]
        turned = any(low[j] in NEGATIONS for j in before)
        x *= -0.74 if turned else 1
        if but is not None and i != but:
            x *= 0.5 if i < but else 1.5
        felt.append(x)
        if v is not None:
            near = 0 if i == 0 else (low[i - 1] in BOOSTERS) - (low[i - 1] in DAMPENERS)
            weight = {1: 1.3, -1: 0.7, 0: 1.0}[near]
            if v:
                polar.append(max(-1, min(1, v / 400 * weight * (-0.5 if turned else 1))))
            subjective.append((min(1, s / 100 * weight), v))
    text = text or ""
    asked = text.count("?")
    marks = min(text.count("!"), 4) * 0.292 + (0.96 if asked > 3 else asked * 0.18 if asked > 1 else 0)
    total = sum(felt)
    total += marks * ((total > 1e-12) - (total < -1e-12))
    up = sum(x + 1 for x in felt if x > 1e-12)
    down = sum(1 - x for x in felt if x < -1e-12)
    flat = sum(abs(x) <= 1e-12 for x in felt)
    up, down = up + marks * (up > down + 1e-12), down + marks * (down > up + 1e-12)
    mass = up + down + flat
    shares = (up / mass, down / mass, flat / mass) if mass else (0, 0, 1)
    mean = lambda xs: sum(xs) / len(xs) if xs else 0
    return (total / (total * total + 15) ** 0.5, *shares, mean(polar), mean([s for s, _ in subjective]))


TEXTS = ["good", "not good", "VERY good!!!", "very good", "GOOD!!!", "good but bad", "bad but good",
         "slightly good", "not very good", "never was it really so good", "it is GOOD and bad",
         "GOOD BAD", "good bad?", "good??", "good????", "bad!!!!!!", "plain", "very", "", None, "x y z",
         "no no no", "not bad at all but GREAT", "but good", "good but", "VERY VERY VERY good plain",
         "don't like, good", "good " * 3000 + "but " + "bad " * 2000, "kinda HARDLY good day"]


def test_like_a_plain_loop(spark, words):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").repartition(3)
    got = {r.id: r for r in lex.label_sentiment(rows, "id", "t", words).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r, want = got[i], brute(text)
        found = (r.vader_compound, r.vader_positive, r.vader_negative, r.vader_neutral,
                 r.textblob_polarity, r.textblob_subjectivity)
        assert found == pytest.approx(want, abs=6e-4), text


def test_the_rules_change_the_scores_as_they_should(spark, words):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    got = {TEXTS[r.id]: r for r in lex.label_sentiment(rows, "id", "t", words).collect()}
    score = {t: r.vader_compound for t, r in got.items()}
    assert score["not good"] < 0 < score["slightly good"] < score["good"] < score["very good"]
    assert score["very good"] < score["VERY good!!!"]
    assert score["good but bad"] < 0 < score["bad but good"]
    assert got["not good"].sentiment == "Negative" and got["plain"].sentiment == "Neutral"
    assert score["good"] == round(1.9 / (1.9 ** 2 + 15) ** 0.5, 4)
    assert score["not good"] == round(-1.406 / (1.406 ** 2 + 15) ** 0.5, 4)
    loudest = 1.9 + 0.293 + 0.733 + 3 * 0.292
    assert score["VERY good!!!"] == round(loudest / (loudest ** 2 + 15) ** 0.5, 4)


def test_learnt_words_have_a_subjectivity_of_their_own(spark):
    rows = spark.createDataFrame(
        [("fine day", True)] * 8 + [("poor day", False)] * 8, "t string, up boolean")
    from pyspark.sql import functions as F
    got = {r.word: r for r in lex.learn_lexicon(rows, "t", F.col("up"), 5).collect()}
    assert got["day"].valence == 0 and got["day"].subjectivity == 0
    assert got["fine"].subjectivity == got["poor"].subjectivity == 80
    assert got["fine"].valence == -got["poor"].valence > 0


def test_words_in_context_are_compiled(spark):
    """Only capitals and kinds of a word are interpreted functions; what stands around it is a row."""
    df = spark.createDataFrame([(1, "So VERY good BuT not bad")], "id long, t string")
    found = lex.words_in_context(df, "id", "t")
    shown = found._jdf.queryExecution().analyzed().toString()
    assert shown.count("lambdafunction(") <= 3
    assert [(r.word, r.side, r.turned) for r in found.collect()] == [
        ("so", 5, False), ("very", 5, False), ("good", 5, False), ("but", 10, False),
        ("not", 15, False), ("bad", 15, True)]
