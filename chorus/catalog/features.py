"""Named queries: keywords, lexicon sentiment, language profiles, TF-IDF, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorus.catalog.derive import lit, marked_documents
from chorus.catalog.registry import query
from chorus.catalog.text import BY_SCRIPT, SQL_COUNTS, STEPS, STOPS, TOKENS
from chorus.config import TfidfConfig
from chorus.functions import text as tx
from chorus.operators import keywords, language, lexicon, tfidf
from chorus.operators.rows import unfold
from chorus.plans import pipeline
from chorus.sources.tables import documents, load
from chorus.wordlists import (BOOSTERS, CATEGORY_KEYWORDS, CLASS_KEYWORDS, DAMPENERS,
                              EMPLOYMENT_KEYWORDS, NEGATIONS, UNEMPLOYMENT_KEYWORDS)
from chorus.workspace import stage

LANGS = ("de", "en", "es", "fr")


def sql_hits(words) -> str:
    """List of the keywords contained in column t."""
    cases = ", ".join(f"CASE WHEN contains(t, {lit(w.lower())}) THEN {lit(w)} END" for w in words)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


@query("WITH low AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, " + ", ".join(
    f"array_to_string({sql_hits(w)}, ',') AS {n}" for n, w in CLASS_KEYWORDS.items()) + " FROM low")
def keyword_hits(spark, d):
    hits = keywords.keyword_hits(documents(spark, d, "doc_id", "text"), "text")
    return hits.select("doc_id", *[F.array_join(n, ",").alias(n) for n in CLASS_KEYWORDS])


@query(f"""WITH w AS (SELECT lang, unnest(list_filter({TOKENS}, lambda x: x NOT IN {STOPS})) AS term
    FROM documents),
  c AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL)
SELECT lang, term, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS INTEGER)
  AS rank FROM c QUALIFY rank <= 10""")
def top_terms_by_class(spark, d):
    docs = documents(spark, d, "doc_id", "lang", "text")
    words = unfold(docs, tx.without(tx.tokens(F.col("text")), tfidf.STOP_WORDS), "term", "lang")
    counts = words.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    return keywords.top_per_class(counts, "lang", "term", "n", 10)


_PHRASES = [*EMPLOYMENT_KEYWORDS, *UNEMPLOYMENT_KEYWORDS]


@query(f"""WITH posts AS (SELECT lower(text || ' ' ||
    ([{', '.join(lit(p) for p in _PHRASES)}])[(doc_id % {len(_PHRASES)} + 1)::INT]) AS t FROM documents),
  h AS (SELECT {', '.join(f"len({sql_hits(w)}) AS {c}" for c, w in CATEGORY_KEYWORDS.items())} FROM posts)
SELECT category, count(*) FILTER (hits > 0) AS texts, CAST(sum(hits) AS BIGINT) AS hits FROM (
  SELECT unnest(['employment', 'unemployment']) AS category, unnest([employment, unemployment]) AS hits
  FROM h) GROUP BY category""")
def category_tagging(spark, d):
    """Texts per search category; every document carries one search phrase more."""
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]),
                          (F.col("doc_id") % len(_PHRASES) + 1).cast("int"))
    posts = documents(spark, d, "doc_id", "text").select(
        F.concat("text", F.lit(" "), phrase).alias("text"))
    return keywords.category_coverage(posts, "text")


LEARNT = f"""voted AS (SELECT toxic = 0 AND quality = 1 AS up, list_distinct({TOKENS}) AS w
  FROM documents JOIN labels USING (doc_id)),
tot AS (SELECT count(*) FILTER (up) AS u, count(*) FILTER (NOT up) AS n FROM voted),
words AS (SELECT word, count(*) FILTER (up) AS up, count(*) FILTER (NOT up) AS down
  FROM (SELECT up, unnest(w) AS word FROM voted) GROUP BY word HAVING count(*) >= 5),
shares AS (SELECT word, up + down AS df, (up + 1) / (u + 2) AS a, (down + 1) / (n + 2) AS b FROM words, tot),
valued AS (SELECT word, df, greatest(least(CAST(round(100 * (ln(a) - ln(b))) AS BIGINT), 400), -400)
  AS valence, CAST(round(abs(a - b) / (a + b) * 100) AS BIGINT) AS subjectivity FROM shares),
lexicon AS (SELECT word, valence, subjectivity FROM valued)"""

_CAPITALS = "(regexp_matches(x, '^[\\p{Lu}\\p{N}_]+$') AND regexp_matches(x, '\\p{Lu}'))"


def _words(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def _before(distance: int) -> str:
    """Kind of the word so many places before word i; nothing stands before the first."""
    return f"(CASE WHEN i > {distance} THEN k[i - {distance}] ELSE 0 END)"


def _boost(distance: int) -> str:
    k, b, c = _before(distance), lexicon.BOOST[distance - 1], lexicon.CAPITALS[distance - 1]
    return f"(CASE {k} WHEN 1 THEN {b} WHEN 2 THEN {b + c} WHEN -1 THEN {-b} WHEN -2 THEN {-b - c} ELSE 0 END)"


def sql_scores(table: str, text: str) -> str:
    """Scores of every row of a table under the learnt lexicon, by the rules of context."""
    asked = f"(len({text}) - len(replace({text}, '?', '')))"
    return f"""cut AS (SELECT doc_id, regexp_extract_all({text}, {lit(tx.WORD)}) AS w,
  least(len({text}) - len(replace({text}, '!', '')), {lexicon.MOST_EXCLAMATIONS}) * {lexicon.EXCLAMATION}
  + CASE WHEN {asked} > 3 THEN {lexicon.MANY_QUESTIONS} WHEN {asked} > 1 THEN {asked} * {lexicon.QUESTION}
    ELSE 0 END AS marks FROM {table}),
heard AS (SELECT *, len(list_filter(w, lambda x: {_CAPITALS})) BETWEEN 1 AND len(w) - 1 AS mixed,
  coalesce(list_position(list_transform(w, lambda x: lower(x)), 'but'), 0) AS but FROM cut),
kinds AS (SELECT *, list_transform(w, lambda x: CASE WHEN lower(x) IN {_words(NEGATIONS)} THEN 9
  WHEN lower(x) IN {_words(BOOSTERS)} THEN CASE WHEN mixed AND {_CAPITALS} THEN 2 ELSE 1 END
  WHEN lower(x) IN {_words(DAMPENERS)} THEN CASE WHEN mixed AND {_CAPITALS} THEN -2 ELSE -1 END
  ELSE 0 END) AS k FROM heard),
placed AS (SELECT doc_id, mixed, but, k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM kinds),
toks AS (SELECT doc_id, lower(x) AS word, {_boost(1)} + {_boost(2)} + {_boost(3)} AS boost,
  mixed AND {_CAPITALS} AS loud, 9 IN ({_before(1)}, {_before(2)}, {_before(3)}) AS turned,
  CASE WHEN {_before(1)} IN (1, 2) THEN 13 WHEN {_before(1)} < 0 THEN 7 ELSE 10 END AS near,
  CASE WHEN but = 0 OR i = but THEN 10 WHEN i < but THEN {lexicon.BEFORE_BUT}
    ELSE {lexicon.AFTER_BUT} END AS side FROM placed),
felt AS (SELECT doc_id, word, valence, (valence * 10000 + sign(valence) * (CASE WHEN loud
    THEN {lexicon.CAPITALS[0]} ELSE 0 END + boost))
    * (CASE WHEN turned THEN {lexicon.TURNED} ELSE 100 END) * side AS f,
  CASE WHEN valence IS NOT NULL THEN greatest(least(valence * 2 * near
    * (CASE WHEN turned THEN -1 ELSE 2 END), 16000), -16000) END AS p,
  CASE WHEN valence IS NOT NULL THEN least(subjectivity * near, 1000) END AS subject FROM toks LEFT JOIN lexicon USING (word)),
summed AS (SELECT doc_id, coalesce(sum(f), 0)::BIGINT AS total, count(*) FILTER (valence <> 0) AS matched,
  coalesce(sum(f + 1000000000) FILTER (f > 0), 0)::BIGINT AS ups,
  coalesce(sum(1000000000 - f) FILTER (f < 0), 0)::BIGINT AS downs,
  count(*) FILTER (word IS NOT NULL AND coalesce(f, 0) = 0) AS neutral,
  coalesce(sum(p), 0)::BIGINT AS polar, coalesce(sum(subject), 0)::BIGINT AS subjective,
  count(valence) AS known FROM cut LEFT JOIN felt USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, matched, polar, subjective, known, neutral * 1000000000 AS neutral,
  (total + sign(total) * marks)::DOUBLE / 1000000000 AS s,
  ups + CASE WHEN ups > downs THEN marks ELSE 0 END AS up,
  downs + CASE WHEN downs > ups THEN marks ELSE 0 END AS down FROM summed JOIN cut USING (doc_id)),
scored AS (SELECT doc_id, round(s / sqrt(s * s + 15), 4) AS vader_compound,
  round(coalesce(up::DOUBLE / nullif(up + down + neutral, 0), 0.0), 3) AS vader_positive,
  round(coalesce(down::DOUBLE / nullif(up + down + neutral, 0), 0.0), 3) AS vader_negative,
  round(coalesce(neutral::DOUBLE / nullif(up + down + neutral, 0), 1.0), 3) AS vader_neutral,
  coalesce(polar / 16000.0::DOUBLE / nullif(matched, 0), 0.0) AS textblob_polarity,
  coalesce(subjective / 1000.0::DOUBLE / nullif(known, 0), 0.0) AS textblob_subjectivity
  FROM sums)"""


LEXICON = LEARNT + ",\n" + sql_scores("documents", "text")


def learnt_lexicon(spark, d):
    docs = documents(spark, d, "doc_id", "text").join(load(spark, d, "labels"), "doc_id")
    return lexicon.learn_lexicon(docs, "text", (F.col("toxic") == 0) & (F.col("quality") == 1))


@query(f"""WITH {LEXICON} SELECT doc_id, vader_compound, vader_positive, vader_negative, vader_neutral
FROM scored""")
def lexicon_sentiment(spark, d):
    return lexicon.lexicon_sentiment(documents(spark, d, "doc_id", "text"), "doc_id", "text",
                                     learnt_lexicon(spark, d))


@query(f"WITH {LEXICON} SELECT doc_id, textblob_polarity, textblob_subjectivity FROM scored")
def lexicon_polarity(spark, d):
    return lexicon.lexicon_polarity(documents(spark, d, "doc_id", "text"), "doc_id", "text",
                                    learnt_lexicon(spark, d))


@query(f"""WITH {LEXICON} SELECT *, CASE WHEN vader_compound >= 0.05 THEN 'Positive'
  WHEN vader_compound <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM scored""")
def sentiment_label(spark, d):
    return lexicon.label_sentiment(documents(spark, d, "doc_id", "text"), "doc_id", "text",
                                   learnt_lexicon(spark, d))


#: Openings whose rules are known, in front of every document, and the words they are made of.
OPENINGS = ("good", "not good", "VERY good!!!", "very good", "slightly good", "good but bad", "GOOD day",
            "never was really bad??", "GOOD BAD!", "the idea is not so very good", "?????", "")
OPENING_WORDS = (("good", 190, 60), ("bad", -250, 67), ("idea", 0, 10), ("but", 0, 0))
_OPENED = (f"opened AS (SELECT doc_id, ([{', '.join(lit(o) for o in OPENINGS)}])[(doc_id % {len(OPENINGS)}"
           " + 1)::INT] || '. ' || text AS text FROM documents),\n")
_WITH_WORDS = LEARNT.replace("lexicon AS (SELECT", f"""given AS (SELECT * FROM (VALUES {', '.join(
    f"({lit(w)}, {v}::BIGINT, {s}::BIGINT)" for w, v, s in OPENING_WORDS)}) AS g(word, valence, subjectivity)),
lexicon AS (SELECT * FROM given UNION ALL SELECT""").replace("FROM valued)", """FROM valued
  WHERE word NOT IN (SELECT word FROM given))""")


@query(f"WITH {_OPENED}{_WITH_WORDS}, {sql_scores('opened', 'text')} SELECT * FROM scored")
def sentiment_rules(spark, d):
    """All scores of documents that open with negated, strengthened and contrasted words."""
    opening = F.element_at(F.array(*[F.lit(o) for o in OPENINGS]),
                           (F.col("doc_id") % len(OPENINGS) + 1).cast("int"))
    texts = documents(spark, d, "doc_id", "text").select(
        "doc_id", F.concat(opening, F.lit(". "), "text").alias("text"))
    given = spark.createDataFrame(OPENING_WORDS, "word string, valence bigint, subjectivity bigint")
    words = given.unionByName(learnt_lexicon(spark, d).join(given, "word", "left_anti"))
    return lexicon.label_sentiment(texts, "doc_id", "text", stage(words, "lexicon")).drop("sentiment")


LABELLED = f"""{LEXICON}, labelled AS (SELECT doc_id, text, lower(text) AS t,
  CASE WHEN vader_compound >= 0.05 THEN 'Positive' WHEN vader_compound <= -0.05 THEN 'Negative'
  ELSE 'Neutral' END AS sentiment FROM documents JOIN scored USING (doc_id)),
hits AS (SELECT *, """ + ", ".join(
    f"{sql_hits(w)} AS {n}" for n, w in CLASS_KEYWORDS.items()) + " FROM labelled)"


def labelled_documents(spark, d):
    """All documents with the class of their lexicon score."""
    docs = documents(spark, d, "doc_id", "text")
    marks = lexicon.label_sentiment(docs, "doc_id", "text", learnt_lexicon(spark, d))
    return docs.join(marks.select("doc_id", "sentiment"), "doc_id")


FREQUENCY = f"""{LABELLED}, freq AS (SELECT sentiment, keyword, count(*) AS n FROM (
  SELECT sentiment, unnest(list_concat(list_concat(Positive, Negative), Neutral)) AS keyword FROM hits)
  GROUP BY ALL)"""


@query(f"WITH {FREQUENCY} SELECT sentiment, keyword, n FROM freq")
def keyword_freq_by_class(spark, d):
    return keywords.keyword_frequency(labelled_documents(spark, d), "text", "sentiment")


@query(f"""WITH {LABELLED}, f AS (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY doc_id)
    AS rn FROM hits)
SELECT doc_id, sentiment, left(text, 100) AS shown_text, array_to_string((CASE sentiment
  WHEN 'Positive' THEN Positive WHEN 'Negative' THEN Negative ELSE Neutral END)[1:5], ',') AS keywords
FROM f WHERE rn = 1""")
def sample_explanations(spark, d):
    rows = keywords.sample_explanations(labelled_documents(spark, d), "doc_id", "text", "sentiment")
    return rows.withColumn("keywords", F.array_join("keywords", ","))


@query(f"""WITH {STEPS}, kept AS (SELECT * FROM cleaned WHERE trim(cleaned_text) <> ''),
scripted AS (SELECT doc_id, lang, cleaned_text AS text FROM kept), {SQL_COUNTS},
classed AS (SELECT doc_id, {BY_SCRIPT} ELSE CASE lang WHEN 'hi' THEN 'Hindi' WHEN 'en' THEN 'English'
  ELSE 'Code-Mixed' END END AS language FROM counted),
{LEARNT}, {sql_scores('kept', 'cleaned_text')},
labelled AS (SELECT doc_id, CASE WHEN vader_compound >= 0.05 THEN 'Positive'
  WHEN vader_compound <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM scored),
ranked AS (SELECT doc_id, sentiment, row_number() OVER (PARTITION BY sentiment
    ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY sentiment) AS n FROM labelled)
SELECT doc_id, language, sentiment, CASE WHEN rn <= (n * 80) // 100 THEN 'train'
  WHEN rn <= (n * 90) // 100 THEN 'val' ELSE 'test' END AS split, cleaned_text
FROM ranked JOIN classed USING (doc_id) JOIN kept USING (doc_id)""")
def label_and_split(spark, d):
    """All data-engineering stages in one plan: clean, classify, score, label, split."""
    done = pipeline.label_and_split(marked_documents(spark, d), "doc_id", "text", F.col("lang"),
                                    learnt_lexicon(spark, d))
    return done.select("doc_id", "language", "sentiment", "split", "cleaned_text")


_CHARS = (r"regexp_extract_all(' ' || regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g') || ' ', "
          "'(?s).')")
PROFILES = f"""chars AS (SELECT doc_id, lang, {_CHARS} AS c FROM documents),
grams AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(c) - 1),
  lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM chars),
counts AS (SELECT lang, gram, count(*) AS n FROM grams WHERE substr(gram, 2, 1) <> ' ' GROUP BY ALL),
best AS (SELECT * FROM counts),
totals AS (SELECT lang, sum(n) AS t FROM best GROUP BY lang),
wide AS (SELECT gram, {', '.join(
    f"ln(coalesce(CAST(max(n) FILTER (lang = '{c}') AS DOUBLE), 0.5) / ((SELECT t FROM totals WHERE lang = '{c}')"
    f" + 1.0)) AS lp_{c}" for c in LANGS)} FROM best GROUP BY gram),
scored AS (SELECT doc_id, {', '.join(f"round(sum(lp_{c}), 3) AS score_{c}" for c in LANGS)}
  FROM grams JOIN wide USING (gram) GROUP BY doc_id)"""


@query(f"""WITH {PROFILES} SELECT doc_id, score_de, score_en, score_es, score_fr,
  CASE greatest(score_de, score_en, score_es, score_fr) WHEN score_de THEN 'de' WHEN score_en THEN 'en'
  WHEN score_es THEN 'es' WHEN score_fr THEN 'fr' END AS detected
FROM documents LEFT JOIN scored USING (doc_id)""")
def ngram_language_id(spark, d):
    docs = documents(spark, d, "doc_id", "lang", "text")
    profiles = language.learn_profiles(docs, "text", "lang", LANGS)
    return language.detect(docs, "doc_id", "text", profiles, LANGS)


GRAMS = TfidfConfig()
BASE = f"""words AS (SELECT doc_id, lang, list_filter({TOKENS}, lambda x: x NOT IN {STOPS}) AS w
  FROM documents),
terms AS (SELECT doc_id, lang, unnest(list_concat(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term
  FROM words),
tf AS (SELECT doc_id, lang, term, count(*) AS tf FROM terms GROUP BY ALL),
size AS (SELECT count(*) AS n_docs FROM documents),
vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term
  HAVING count(*) >= 5 AND count(*) <= 0.95 * (SELECT n_docs FROM size)
  ORDER BY total DESC, term LIMIT 10000),
raw AS (SELECT doc_id, lang, term, (ln(tf) + 1) * (ln((n_docs + 1) / (df + 1)) + 1) AS r
  FROM tf JOIN vocab USING (term), size),
weighted AS (SELECT doc_id, lang, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS weight FROM raw),
grid AS (SELECT c AS lang, v.term, coalesce(s.w, 0.0) AS w FROM vocab v
  CROSS JOIN (SELECT unnest(['de', 'en', 'es', 'fr']) AS c)
  LEFT JOIN (SELECT lang, term, sum(weight) AS w FROM weighted GROUP BY ALL) s
    ON s.lang = c AND s.term = v.term),
probs AS (SELECT lang, term, ln((w + 1) / sum(w + 1) OVER (PARTITION BY lang)) AS log_prob FROM grid),
coefs AS (SELECT lang, term, log_prob - avg(log_prob) OVER (PARTITION BY term) AS coefficient FROM probs)"""


def term_weights(spark, d, vocab=None):
    docs = load(spark, d, "documents")
    vocab = vocab or tfidf.vocabulary(docs, "doc_id", "text", GRAMS)
    return vocab, tfidf.weights(docs, "doc_id", "text", vocab, GRAMS, keep=["lang"])


@query(f"""WITH {BASE} SELECT term, df, total, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER)
  AS term_id FROM vocab""")
def tfidf_vocab(spark, d):
    return tfidf.vocabulary(load(spark, d, "documents"), "doc_id", "text", GRAMS).drop("n_docs")


@query(f"WITH {BASE} SELECT doc_id, term, round(weight, 6) AS weight FROM weighted")
def tfidf_weights(spark, d):
    _, long = term_weights(spark, d)
    return long.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {BASE} SELECT lang, term, round(log_prob, 6) AS log_prob FROM probs")
def naive_bayes_counts(spark, d):
    vocab, long = term_weights(spark, d)
    return tfidf.class_log_probabilities(long, "lang", LANGS, vocab).withColumn(
        "log_prob", F.round("log_prob", 6))


@query(f"""WITH {BASE}, means AS (SELECT term, sum(weight) / (SELECT n_docs FROM size) AS m
    FROM weighted GROUP BY term),
  priors AS (SELECT lang, ln(count(*) / (SELECT n_docs FROM size)) AS log_prior FROM documents GROUP BY lang),
  votes AS (SELECT doc_id, p.lang, round(sum(weight * log_prob) + any_value(log_prior), 9) AS s
    FROM weighted w JOIN probs p USING (term) JOIN priors r ON r.lang = p.lang GROUP BY doc_id, p.lang),
  guessed AS (SELECT doc_id, min(lang) AS lang FROM votes
    WHERE (doc_id, s) IN (SELECT doc_id, max(s) FROM votes GROUP BY doc_id) GROUP BY doc_id),
  shares AS (SELECT lang, term, coefficient * (weight - m) AS contribution
    FROM (SELECT doc_id, term, weight FROM weighted) JOIN guessed USING (doc_id)
    JOIN coefs USING (lang, term) JOIN means USING (term)),
  agg AS (SELECT lang, term, count(*) AS texts, round(sum(contribution), 6) AS contribution
    FROM shares WHERE contribution > 0.05 GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY contribution DESC, term) AS INTEGER) AS rank
FROM agg QUALIFY rank <= 15""")
def token_contributions(spark, d):
    """Terms that speak most for each predicted language under a naive Bayes linear model."""
    from pyspark.sql import Window
    vocab, long = term_weights(spark, d)
    long = stage(long, "tfidf-weights")
    docs = load(spark, d, "documents")
    texts = docs.count()
    probs = stage(tfidf.class_log_probabilities(long, "lang", LANGS, vocab), "log-probabilities")
    priors = docs.groupBy("lang").agg(F.ln(F.count(F.lit(1)) / texts).alias("log_prior"))
    guessed = tfidf.predicted_classes(long, "doc_id", "lang", probs, priors)
    judged = long.drop("lang").join(guessed, "doc_id")
    coefs = probs.select("lang", "term", (F.col("log_prob") - F.avg("log_prob").over(
        Window.partitionBy("term"))).alias("coefficient"))
    shares = tfidf.contributions(judged, "doc_id", "lang", stage(coefs, "coefficients"), texts)
    sums = shares.groupBy("lang", "term").agg(
        F.count(F.lit(1)).alias("texts"), F.round(F.sum("contribution"), 6).alias("contribution"))
    return keywords.top_per_class(sums, "lang", "term", "contribution", 15)
