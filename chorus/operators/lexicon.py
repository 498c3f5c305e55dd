"""Lexicon sentiment: valence per word, rules of context, scores per text, class by threshold.

A lexicon is a table ``(word, valence, subjectivity)``: valence in whole hundredths from
-400 to 400, subjectivity in whole percent. It can be supplied or learnt from labelled
texts; without a column ``subjectivity`` that of a word follows from its valence.

Rules change the valence of a word where it stands:

* a word in capitals, in a text that is not all capitals, counts for more;
* an intensifier or a dampener among the three words before it adds or takes away, less
  with distance, more if it is in capitals itself;
* a negation among the three words before it turns and weakens it;
* words before the first "but" count half, those after it one and a half times.

Exclamation and repeated question marks strengthen the whole text. What the rules need is
a window of words, so it is made on the array of words, before the words meet the
lexicon. Every figure of a word is a whole number of billionths, so that sums are exact
whatever the order of the rows, and are formed before one short row per text is shuffled.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from chorus.functions import scores, text as tx
from chorus.operators.rows import unfold
from chorus.wordlists import BOOSTERS, DAMPENERS, NEGATIONS
from chorus.workspace import stage

LIMIT = 400  # the scale of a valence, in hundredths
NORMALIZER = 15
UNIT = 1_000_000_000  # one point of valence

# The weights of the rules, as published for rule-based sentiment.
BOOST = (293_000, 278_350, 263_700)  # millionths, by the distance of the intensifier
CAPITALS = (733_000, 696_350, 659_700)  # of a word itself, of an intensifier two or three before
TURNED = -74  # percent
BEFORE_BUT, AFTER_BUT = 5, 15  # tenths
EXCLAMATION, MOST_EXCLAMATIONS = 292_000_000, 4
QUESTION, MANY_QUESTIONS = 180_000_000, 960_000_000
#: Weights of intensifier, dampener and neither for polarity, in tenths.
POLARITY = {"up": 13, "down": 7, "none": 10}

# Kinds of words: an intensifier (2 if in capitals), a dampener, a negation.
_TURN = 9


def learn_lexicon(df: DataFrame, text: str, positive: Column, min_df: int = 5) -> DataFrame:
    """Log-odds of a word between positive and negative texts as its valence.

    Every word of at least ``min_df`` texts enters. Valences lie on the scale of
    the scores, from -4 to 4. The subjectivity of a word is how unevenly the two
    sides use it.
    """
    marked = df.select(positive.alias("_up"), F.array_distinct(tx.tokens(F.col(text))).alias("_w"))
    totals = marked.agg(F.struct(F.count_if("_up").alias("up"),
                                 F.count_if(~F.col("_up")).alias("down")).alias("t"))
    words = unfold(marked, F.col("_w"), "word", "_up").groupBy("word").agg(
        F.count_if("_up").alias("up"), F.count_if(~F.col("_up")).alias("down"))
    kept = words.filter(F.col("up") + F.col("down") >= min_df).withColumn("_t", totals.scalar())
    up, down = (F.col("up") + 1) / (F.col("_t.up") + 2), (F.col("down") + 1) / (F.col("_t.down") + 2)
    valence = F.round((F.ln(up) - F.ln(down)) * 100).cast("bigint")
    return stage(kept.select(
        "word", F.greatest(F.least(valence, F.lit(LIMIT)), F.lit(-LIMIT)).alias("valence"),
        F.round(F.abs(up - down) / (up + down) * 100).cast("bigint").alias("subjectivity")), "lexicon")


def _in_capitals(word: Column) -> Column:
    return word.rlike(r"^[\p{N}_]*\p{Lu}[\p{Lu}\p{N}_]*$")


def _kind(word: Column, mixed: Column) -> Column:
    """What a word does to those after it; intensifiers 1, dampeners -1, twice that in capitals."""
    low = F.lower(word)
    loud = F.when(mixed & _in_capitals(word), 2).otherwise(1)
    return (F.when(low.isin(*NEGATIONS), _TURN).when(low.isin(*BOOSTERS), loud)
            .when(low.isin(*DAMPENERS), -loud).otherwise(0))


#: All ways to write "but": the place of a word is found without making its lower case.
_BUTS = tuple("".join(letters) for letters in product("bB", "uU", "tT"))


def words_in_context(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per word with what the rules found around it; a text without words keeps a row.

    Columns: word in lower case, ``boost`` (millionths), ``loud``, ``turned``, ``near`` (kind
    of the word before), ``side`` (tenths) and ``marks``, the strength of the text's marks.
    The kinds of the three words before travel in the row of a word, so that all but two
    short functions of a word are compiled.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda mark: F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))
    asked = count("?")
    marks = (F.least(count("!"), F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION
             + F.when(asked > 3, MANY_QUESTIONS).when(asked > 1, asked * QUESTION).otherwise(0))
    # Each array passes through a generator, so that it is computed once and not in every lambda.
    cut = df.select(id_col, marks.cast("bigint").alias("_marks"), F.explode(F.array(
        F.regexp_extract_all(t, F.lit(tx.WORD), F.lit(0)))).alias("_w"))
    w = F.col("_w")
    loud = F.size(F.filter(w, _in_capitals))
    buts = [F.nullif(F.array_position(w, b), F.lit(0)) for b in _BUTS]
    mixed = F.struct(((loud > 0) & (loud < F.size(w))).alias("mixed"),
                     F.coalesce(F.least(*buts), F.lit(0)).alias("but"))
    known = cut.select(id_col, "_marks", "_w", F.explode(F.array(mixed)).alias("_t"))
    kinds = known.select("*", F.explode(F.array(F.transform(
        w, lambda x: _kind(x, F.col("_t.mixed"))))).alias("_k"))
    later = [F.slice(F.concat(F.array_repeat(F.lit(0), F.lit(distance)), "_k"), F.lit(1), F.size(w))
             for distance in (1, 2, 3)]
    rows = kinds.select(id_col, "_marks", "_t", F.posexplode_outer(F.arrays_zip(w, *later)).alias("_i", "_z"))
    rows = rows.select(id_col, "_marks", "_t.*", "_i", *[
        F.col("_z")[str(at) if at else "_w"].alias(name) for at, name in enumerate(("_x", "_k1", "_k2", "_k3"))])

    boost, turned = F.lit(0), F.lit(False)
    for distance in (1, 2, 3):
        k = F.col(f"_k{distance}")
        part = (F.when(F.abs(k) == 1, BOOST[distance - 1])
                .when(F.abs(k) == 2, BOOST[distance - 1] + CAPITALS[distance - 1]).otherwise(0))
        boost = boost + F.when(k < 0, -part).otherwise(part)
        turned = turned | (k == _TURN)
    x, but, near, i = F.col("_x"), F.col("but"), F.col("_k1"), F.col("_i")
    return rows.select(
        id_col, F.col("_marks").alias("marks"),
        F.lower(x).alias("word"), F.when(x.isNotNull(), boost).cast("bigint").alias("boost"),
        (F.col("mixed") & _in_capitals(x)).alias("loud"), turned.alias("turned"),
        F.when(x.isNull(), None).when(near.between(1, 2), POLARITY["up"]).when(near < 0, POLARITY["down"])
        .otherwise(POLARITY["none"]).alias("near"),
        F.when(x.isNull(), None).when((but == 0) | (i == but - 1), 10).when(i < but - 1, BEFORE_BUT)
        .otherwise(AFTER_BUT).alias("side"))


def text_sums(df: DataFrame, id_col: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Exact sums per text over its words; a text without words keeps its row."""
    if "subjectivity" not in lexicon.columns:
        lexicon = lexicon.withColumn("subjectivity", F.least(
            F.abs(F.col("valence")), F.lit(200)).cast("bigint") / 2)
    v = F.col("valence")
    sign = F.when(v > 0, 1).when(v < 0, -1).otherwise(0)
    raw = v * 10_000 + sign * (F.when(F.col("loud"), CAPITALS[0]).otherwise(0) + F.col("boost"))
    felt = raw * F.when(F.col("turned"), TURNED).otherwise(100) * F.col("side")
    polar = v * 2 * F.col("near") * F.when(F.col("turned"), -1).otherwise(2)
    met = words_in_context(df, id_col, text).join(lexicon, "word", "left").select(
        id_col, "marks", "word", "valence", felt.alias("_felt"),
        F.when(v.isNotNull(), F.greatest(F.least(polar, F.lit(40 * LIMIT)), F.lit(-40 * LIMIT)))
        .alias("_polar"),
        F.when(v.isNotNull(), F.least(F.col("subjectivity") * F.col("near"), F.lit(1000)))
        .cast("bigint").alias("_subject"))
    x, none = F.col("_felt"), F.lit(0)
    return met.groupBy(id_col).agg(
        F.max("marks").alias("marks"),
        F.coalesce(F.sum(x), none).alias("total"),
        F.count_if(v != 0).alias("matched"),
        F.coalesce(F.sum(F.when(x > 0, x + UNIT)), none).alias("up"),
        F.coalesce(F.sum(F.when(x < 0, UNIT - x)), none).alias("down"),
        F.count_if(F.col("word").isNotNull() & (F.coalesce(x, none) == 0)).alias("neutral"),
        F.coalesce(F.sum("_polar"), none).alias("polar"),
        F.coalesce(F.sum("_subject"), none).alias("subjective"),
        F.count("valence").alias("known"))


def valence_scores() -> dict[str, Column]:
    """Compound score and the shares of positive, negative and neutral mass."""
    c = F.col
    sign = F.when(c("total") > 0, 1).when(c("total") < 0, -1).otherwise(0)
    s = (c("total") + sign * c("marks")).cast("double") / UNIT
    up = c("up") + F.when(c("up") > c("down"), c("marks")).otherwise(0)
    down = c("down") + F.when(c("down") > c("up"), c("marks")).otherwise(0)
    mass = up + down + c("neutral") * UNIT
    share = lambda part, empty: F.round(F.coalesce(F.try_divide(part, mass), F.lit(empty)), 3)
    return {
        "vader_compound": F.round(s / F.sqrt(s * s + NORMALIZER), 4),
        "vader_positive": share(up, 0.0),
        "vader_negative": share(down, 0.0),
        "vader_neutral": share(c("neutral") * UNIT, 1.0),
    }


def polarity_scores() -> dict[str, Column]:
    """Mean polarity in [-1, 1] of the words with a valence, subjectivity in [0, 1] of the known."""
    c = F.col
    return {"textblob_polarity": F.coalesce(
                F.try_divide(c("polar") / float(40 * LIMIT), c("matched")), F.lit(0.0)),
            "textblob_subjectivity": F.coalesce(
                F.try_divide(c("subjective") / 1000.0, c("known")), F.lit(0.0))}


def lexicon_sentiment(df: DataFrame, id_col: str, text: str, lexicon: DataFrame) -> DataFrame:
    return text_sums(df, id_col, text, lexicon).select(
        id_col, *[e.alias(n) for n, e in valence_scores().items()])


def lexicon_polarity(df: DataFrame, id_col: str, text: str, lexicon: DataFrame) -> DataFrame:
    return text_sums(df, id_col, text, lexicon).select(
        id_col, *[e.alias(n) for n, e in polarity_scores().items()])


def label_sentiment(df: DataFrame, id_col: str, text: str, lexicon: DataFrame) -> DataFrame:
    """All scores and the sentiment class, one row per text."""
    both = {**valence_scores(), **polarity_scores()}
    scored = text_sums(df, id_col, text, lexicon).select(
        id_col, *[e.alias(n) for n, e in both.items()])
    return scored.withColumn("sentiment", scores.sentiment_class(F.col("vader_compound")))
