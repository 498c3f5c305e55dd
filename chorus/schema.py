"""Table schemas used across the library."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*specs: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in specs])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_TS, _B, _DATE = T.TimestampType(), T.BooleanType(), T.DateType()

RAW_POSTS = _fields(
    ("id", _L, True), ("source", _S, False), ("post_id", _S, True), ("text", _S, False),
    ("author", _S, True), ("created_date", _TS, True), ("url", _S, True),
    ("location", _S, True), ("platform_metadata", _S, True), ("collected_date", _TS, True),
    ("likes", _I, True), ("comments_count", _I, True), ("shares", _I, True),
    ("is_processed", _B, True),
)

PROCESSED_POSTS = _fields(
    ("id", _L, True), ("raw_post_id", _L, False), ("cleaned_text", _S, True),
    ("language", _S, True), ("vader_positive", _D, True), ("vader_negative", _D, True),
    ("vader_neutral", _D, True), ("vader_compound", _D, True),
    ("textblob_polarity", _D, True), ("textblob_subjectivity", _D, True),
    ("ml_sentiment", _S, True), ("ml_confidence", _D, True), ("primary_emotion", _S, True),
    ("emotion_scores", _S, True), ("topics", _S, True), ("processed_date", _TS, True),
)

COLLECTION_STATS = _fields(
    ("source", _S, True), ("collection_date", _DATE, True), ("posts_collected", _L, True),
    ("errors_count", _L, True), ("collection_duration_seconds", _D, True), ("notes", _S, True),
)
