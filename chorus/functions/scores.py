"""Scores to classes: sentiment thresholds, softmax, argmax, confidence maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

SENTIMENT_THRESHOLD = 0.05


def sentiment_class(compound: Column) -> Column:
    """Both limits belong to the outer classes."""
    return (F.when(compound >= SENTIMENT_THRESHOLD, "Positive")
            .when(compound <= -SENTIMENT_THRESHOLD, "Negative")
            .otherwise("Neutral"))


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores, shifted by the maximum."""
    same = lambda value, like: F.array_repeat(value, F.size(like))
    powers = F.zip_with(scores, same(F.array_max(scores), scores), lambda s, top: F.exp(s - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, p: a + p)
    return F.zip_with(powers, same(total, powers), lambda p, t: p / t)


def argmax(scores: Column) -> Column:
    """0-based place of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def confidence_map(labels: Sequence[str], probabilities: Column, digits: int = 4) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(c) for c in labels]),
                             F.transform(probabilities, lambda p: F.round(p, digits)))
