"""Inputs the named queries share, built the same way in Spark and in SQL.

The test documents hold no mentions, links, emoji or Devanagari. These views
add some to every document by its id, so the text operators have work to do;
all documents and all of each text stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chorus.sources.tables import documents, load

PREFIXES = (
    "&#39;Tis &amp; so ", "@user_1-x ", "see https://ex.am/p?q=1#frag ", "नौकरी चाहिए ",
    "ok 😀👍🏽 ", "what?!?! ", "www.ex.am/a~b   ", "“so” ",
)
LATIN_LETTERS = "abcdefghijklmnopqrstuvwxyz"
DEVANAGARI_LETTERS = "कखगघङचछजझञटठडढणतथदधनपफबभमय"
HALF = 13


def lit(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _choose(key: Column, values: list[Column]) -> Column:
    chosen = F.when(key % len(values) == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        chosen = chosen.when(key % len(values) == i, v)
    return chosen


def marked_documents(spark: SparkSession, d: str) -> DataFrame:
    prefix = _choose(F.col("doc_id"), [F.lit(p) for p in PREFIXES])
    return documents(spark, d, "doc_id", "source", "lang", "text").select(
        "doc_id", "source", "lang", F.concat(prefix, F.col("text")).alias("text"))


MARKED = ("marked AS (SELECT doc_id, source, lang, CASE doc_id % " + str(len(PREFIXES)) + " "
          + " ".join(f"WHEN {i} THEN {lit(p)}" for i, p in enumerate(PREFIXES))
          + " END || text AS text FROM documents)")


def scripted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents in Latin, partly Devanagari or wholly Devanagari letters."""
    text = F.col("text")
    versions = [
        F.translate(F.lower(text), LATIN_LETTERS, DEVANAGARI_LETTERS),
        F.translate(F.lower(text), LATIN_LETTERS[:HALF], DEVANAGARI_LETTERS[:HALF]),
        text, text,
    ]
    return documents(spark, d, "doc_id", "source", "lang", "text").select(
        "doc_id", "source", "lang", _choose(F.col("doc_id"), versions).alias("text"))


SCRIPTED = f"""scripted AS (SELECT doc_id, source, lang, CASE doc_id % 4
  WHEN 0 THEN translate(lower(text), '{LATIN_LETTERS}', '{DEVANAGARI_LETTERS}')
  WHEN 1 THEN translate(lower(text), '{LATIN_LETTERS[:HALF]}', '{DEVANAGARI_LETTERS[:HALF]}')
  ELSE text END AS text FROM documents)"""


def event_posts(spark: SparkSession, d: str) -> DataFrame:
    """Events as posts with a metadata column whose category may be missing."""
    kind = F.col("event_type")
    meta = (F.when(kind == "view", '{"category": ""}')
            .when(kind == "click", '{"category": null}')
            .when(kind == "error", F.lit(None))
            .otherwise(F.concat(F.lit('{"category": "'), kind, F.lit('", "video_id": "'),
                                F.get_json_object("props", "$.k"), F.lit('"}'))))
    return load(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value",
                                           meta.alias("metadata"))


EVENT_POSTS = """event_posts AS (SELECT event_id, ts, user_id, event_type, value,
  CASE event_type WHEN 'view' THEN '{"category": ""}' WHEN 'click' THEN '{"category": null}'
  WHEN 'error' THEN NULL
  ELSE '{"category": "' || event_type || '", "video_id": "'
       || json_extract_string(props, '$.k') || '"}' END AS metadata FROM events)"""

SQL_SPACES = (r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
              r"\x{202f}\x{205f}\x{3000}")
