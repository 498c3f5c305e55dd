"""Named queries: cleaning, scripts, tokens, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorus.catalog.derive import (MARKED, SCRIPTED, SQL_SPACES, lit, marked_documents,
                                   scripted_documents)
from chorus.catalog.registry import query
from chorus.functions import scores, scripts, text as tx
from chorus.operators import cleaning, language, sequences
from chorus.sources.tables import documents, load, spread
from chorus.wordlists import CURLY_QUOTES, EMOJI_NAMES, STOP_WORDS, STRAIGHT_QUOTES


def sql_entities(x: str) -> str:
    for pattern, char in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"),
                          ("&#39;", "'"), ("&amp;?", "&")):
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(char)}, 'g')"
    return x


def sql_remove(x: str, *patterns: str) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, {lit(p)}, '', 'g')"
    return x


def sql_spaces(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit('[' + SQL_SPACES + ']+')}, ' ', 'g'))"


def sql_stops(x: str) -> str:
    return f"regexp_replace({x}, {lit(tx.REPEATED_STOPS)}, '\\1', 'g')"


STEPS = f"""{MARKED},
s1 AS (SELECT *, {sql_entities('text')} AS t1 FROM marked),
s2 AS (SELECT *, {sql_remove('t1', tx.EMOJI)} AS t2 FROM s1),
s3 AS (SELECT *, {sql_remove('t2', tx.MENTION)} AS t3 FROM s2),
s4 AS (SELECT *, {sql_remove('t3', tx.HTTP_URL, tx.WWW_URL)} AS t4 FROM s3),
s5 AS (SELECT *, {sql_spaces('t4')} AS t5 FROM s4),
cleaned AS (SELECT *, {sql_stops('t5')} AS cleaned_text FROM s5)"""

TOKENS = f"regexp_extract_all(lower(text), {lit(tx.WORD)})"
STOPS = "(" + ", ".join(lit(w) for w in STOP_WORDS) + ")"


@query(f"""SELECT page_id, {sql_entities('html')} AS html FROM pages""")
def decode_entities(spark, d):
    return spread(load(spark, d, "pages").select("page_id", "html"), "page_id").select("page_id", tx.decode_entities(F.col("html")).alias("html"))


def _one_step(spark, d, step):
    return marked_documents(spark, d).select("doc_id", step(F.col("text")).alias("text"))


@query(f"WITH {MARKED} SELECT doc_id, {sql_remove('text', tx.EMOJI)} AS text FROM marked")
def remove_emoji(spark, d):
    return _one_step(spark, d, tx.remove_emoji)


_NAMES = (f"MAP([{', '.join(map(lit, EMOJI_NAMES))}], [{', '.join(map(lit, EMOJI_NAMES.values()))}])")


@query(f"""WITH {MARKED}, names AS (SELECT {_NAMES} AS m),
parts AS (SELECT doc_id, text, regexp_extract_all(text, {lit(tx.SIGN_OR_REST)}) AS p FROM marked)
SELECT doc_id, array_to_string(list_transform(p,
  lambda x: coalesce(m[replace(x, chr(65039), '')], x)), '') AS text FROM parts, names""")
def name_emoji(spark, d):
    return _one_step(spark, d, tx.name_emoji)


@query(f"WITH {MARKED} SELECT doc_id, {sql_remove('text', tx.MENTION)} AS text FROM marked")
def remove_mentions(spark, d):
    return _one_step(spark, d, tx.remove_mentions)


@query(f"WITH {MARKED} SELECT doc_id, {sql_remove('text', tx.HTTP_URL, tx.WWW_URL)} AS text FROM marked")
def remove_urls(spark, d):
    return _one_step(spark, d, tx.remove_urls)


@query(f"WITH {MARKED} SELECT doc_id, {sql_spaces('text')} AS text FROM marked")
def normalize_ws(spark, d):
    return _one_step(spark, d, tx.normalize_spaces)


@query(f"""WITH {MARKED} SELECT doc_id,
translate(text, {lit(CURLY_QUOTES)}, {lit(STRAIGHT_QUOTES)}) AS text FROM marked""")
def normalize_quotes(spark, d):
    return _one_step(spark, d, tx.straighten_quotes)


@query(f"WITH {MARKED} SELECT doc_id, {sql_stops('text')} AS text FROM marked")
def collapse_punct(spark, d):
    return _one_step(spark, d, tx.collapse_stops)


@query(f"""WITH {STEPS} SELECT doc_id, source, cleaned_text, length(text) AS original_length,
  length(cleaned_text) AS cleaned_length,
  round((length(text) - length(cleaned_text)) / length(text) * 100, 2) AS length_reduction_pct
FROM cleaned WHERE trim(cleaned_text) <> ''""")
def clean_stage(spark, d):
    """The flagship: all cleaning steps, lengths, blank rows dropped."""
    return cleaning.clean_dataset(marked_documents(spark, d)).select(
        "doc_id", "source", "cleaned_text", "original_length", "cleaned_length",
        "length_reduction_pct")


@query(f"""WITH {STEPS} SELECT count(*) AS initial_rows,
  count(*) FILTER (t1 <> text) AS html_entities_decoded,
  count(*) FILTER (regexp_matches(t1, {lit(tx.EMOJI)})) AS emojis_found,
  count(*) FILTER (t3 <> t2) AS mentions_removed, count(*) FILTER (t4 <> t3) AS urls_removed,
  count(*) FILTER (trim(cleaned_text) = '') AS empty_after_cleaning,
  count(*) FILTER (trim(cleaned_text) <> '') AS final_rows,
  round(avg(CASE WHEN trim(cleaned_text) <> ''
    THEN round((length(text) - length(cleaned_text)) / length(text) * 100, 2) END), 4)
    AS avg_reduction_pct FROM cleaned""")
def clean_stats(spark, d):
    return cleaning.cleaning_stats(marked_documents(spark, d))


@query(f"""WITH {STEPS} SELECT source, round(avg(length(text)), 4) AS avg_original,
  round(avg(length(cleaned_text)), 4) AS avg_cleaned,
  CAST(sum(length(text) - length(cleaned_text)) AS BIGINT) AS chars_removed FROM cleaned GROUP BY source""")
def length_reduction(spark, d):
    done = cleaning.clean_dataset(marked_documents(spark, d))
    return done.groupBy("source").agg(
        F.round(F.avg("original_length"), 4).alias("avg_original"),
        F.round(F.avg("cleaned_length"), 4).alias("avg_cleaned"),
        F.sum(F.col("original_length") - F.col("cleaned_length")).alias("chars_removed"))


SQL_COUNTS = rf"""counted AS (SELECT *,
  len(regexp_extract_all(text, '{scripts.DEVANAGARI}')) AS devanagari,
  length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS english,
  length(replace(text, ' ', '')) AS total,
  length(regexp_replace(text, '^[{SQL_SPACES}]+|[{SQL_SPACES}]+$', '', 'g')) AS trimmed
  FROM scripted)"""

BY_SCRIPT = """CASE WHEN trimmed < 3 OR total = 0 THEN 'Unknown'
  WHEN devanagari * 100 >= total * 15 AND english * 100 >= total * 15 THEN 'Code-Mixed'
  WHEN devanagari * 100 >= total * 80 THEN 'Hindi'
  WHEN english * 100 >= total * 80 THEN 'English'"""


@query(f"""WITH {SCRIPTED}, {SQL_COUNTS} SELECT doc_id, devanagari, english,
  total - devanagari - english AS other, total FROM counted""")
def script_counts(spark, d):
    counts = scripts.script_counts(F.col("text"))
    return scripted_documents(spark, d).select("doc_id", *[c.alias(n) for n, c in counts.items()])


@query(rf"""WITH {SCRIPTED} SELECT doc_id,
  regexp_matches(text, '{scripts.DEVANAGARI}') AS has_devanagari,
  regexp_matches(text, '[a-zA-Z]') AS has_english FROM scripted""")
def script_flags(spark, d):
    return scripted_documents(spark, d).select(
        "doc_id", scripts.has_devanagari(F.col("text")).alias("has_devanagari"),
        scripts.has_latin(F.col("text")).alias("has_english"))


@query(f"""WITH {SCRIPTED}, {SQL_COUNTS} SELECT doc_id, {BY_SCRIPT}
  ELSE CASE lang WHEN 'hi' THEN 'Hindi' WHEN 'en' THEN 'English' ELSE 'Code-Mixed' END
  END AS language FROM counted""")
def language_class(spark, d):
    """Script rules; where they do not decide, the stored language code does."""
    return language.classify(scripted_documents(spark, d), "text", F.col("lang")).select(
        "doc_id", "language")


@query(f"""WITH w AS (SELECT doc_id,
    len(regexp_extract_all(text, {lit('[^' + SQL_SPACES + ']+')})) AS words FROM documents)
SELECT count(*) AS n, count(*) FILTER (words > 512) AS above,
  round(count(*) FILTER (words > 512) * 100.0 / count(*), 4) AS above_pct,
  round(quantile_cont(words, 0.5), 4) AS p50, round(quantile_cont(words, 0.75), 4) AS p75,
  round(quantile_cont(words, 0.9), 4) AS p90, round(quantile_cont(words, 0.95), 4) AS p95,
  round(quantile_cont(words, 0.99), 4) AS p99, CAST(max(words) AS DOUBLE) AS p100 FROM w""")
def sequence_lengths(spark, d):
    return sequences.length_profile(documents(spark, d, "doc_id", "text"), "text", 512)


@query(f"""SELECT doc_id, len({TOKENS}) AS n, array_to_string({TOKENS}, ' ') AS tokens FROM documents""")
def tokens(spark, d):
    words = tx.tokens(F.col("text"))
    return documents(spark, d, "doc_id", "text").select(
        "doc_id", F.size(words).cast("bigint").alias("n"), F.array_join(words, " ").alias("tokens"))


@query(f"""WITH k AS (SELECT doc_id, list_filter({TOKENS}, lambda w: w NOT IN {STOPS}) AS words
  FROM documents) SELECT doc_id, len(words) AS n, array_to_string(words, ' ') AS tokens FROM k""")
def tokens_nostop(spark, d):
    docs = documents(spark, d, "doc_id", "text").select(
        "doc_id", tx.without(tx.tokens(F.col("text")), STOP_WORDS).alias("w"))
    return docs.select("doc_id", F.size("w").cast("bigint").alias("n"),
                       F.array_join("w", " ").alias("tokens"))


SQL_GRAMS = """list_concat(list_concat(w,
  list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])),
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"""


@query(f"""WITH k AS (SELECT doc_id, {TOKENS} AS w FROM documents)
SELECT doc_id, len({SQL_GRAMS}) AS n, md5(array_to_string({SQL_GRAMS}, '|')) AS digest FROM k""")
def ngrams(spark, d):
    grams = documents(spark, d, "doc_id", "text").select(
        "doc_id", tx.ngrams(tx.tokens(F.col("text"))).alias("g"))
    return grams.select("doc_id", F.size("g").cast("bigint").alias("n"),
                        F.md5(F.array_join("g", "|")).alias("digest"))


@query(f"""WITH words AS (SELECT doc_id, unnest({TOKENS}) AS word FROM documents),
  vocab AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS id
    FROM words GROUP BY word),
  placed AS (SELECT doc_id, {TOKENS} AS w FROM documents),
  cut AS (SELECT doc_id, unnest(w[1:128]) AS word, unnest(range(1, least(len(w), 128) + 1)) AS pos
    FROM placed),
  ids AS (SELECT doc_id, list(id ORDER BY pos) AS ids, count(*) AS n
    FROM cut LEFT JOIN vocab USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(ids, ' ') || repeat(' 0', 128 - n), '0' || repeat(' 0', 127))
  AS input_ids, coalesce(n, 0) AS kept, repeat('1', coalesce(n, 0)) || repeat('0', 128 - coalesce(n, 0))
  AS attention_mask FROM documents LEFT JOIN ids USING (doc_id)""")
def seq_encode(spark, d):
    docs = documents(spark, d, "doc_id", "text")
    vocab = sequences.vocabulary(docs, "text")
    coded = sequences.encode(docs, "doc_id", "text", vocab, length=128)
    return coded.select(
        "doc_id", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).cast("bigint").alias("kept"),
        F.array_join(F.col("attention_mask").cast("array<string>"), "").alias("attention_mask"))


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
    FROM embeddings),
  q AS (SELECT vec_id, e, list_max(e) AS top,
    list_sum(list_transform(e, lambda x: exp(x - list_max(e)))) AS total FROM p)
SELECT vec_id, CAST(list_position(e, top) - 1 AS INTEGER) AS predicted_class,
  round(1 / total, 6) AS confidence, round(exp(e[1] - top) / total, 6) AS prob_0 FROM q""")
def softmax_argmax(spark, d):
    probs = spread(load(spark, d, "embeddings"), "vec_id").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn(
        "p", scores.softmax(F.col("e")))
    return probs.select("vec_id", scores.argmax(F.col("e")).alias("predicted_class"),
                        F.round(F.array_max("p"), 6).alias("confidence"),
                        F.round(F.col("p")[0], 6).alias("prob_0"))
