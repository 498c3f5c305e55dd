"""Data work around collecting comments: candidates, shaping, quotas, progress."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chorus.config import CommentConfig
from chorus.operators.ordering import prefix_sums


def unseen(items: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Items whose key was not processed before."""
    return items.join(seen.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def video_candidates(videos: DataFrame, seen: DataFrame, key: str, comments: str,
                     limit: int = 50) -> DataFrame:
    """Unseen videos with comments, most commented first."""
    return (unseen(videos.filter(F.col(comments) > 0), seen, key)
            .orderBy(F.desc(comments), key).limit(limit))


def shape_comments(comments: DataFrame, comment_id: Column, video_id: Column, author: Column,
                   meta: Mapping[str, Column], created: Column, likes: Column,
                   config: CommentConfig = CommentConfig()) -> DataFrame:
    """Comments long enough to keep, as the records that :func:`chorus.sources.posts.append_posts` takes.

    A comment has no comments or shares of its own.
    """
    return comments.filter(F.length("text") >= config.min_chars).select(
        F.concat(F.lit(config.key_prefix), comment_id).alias("post_id"),
        F.substring("text", 1, config.max_chars).alias("text"),
        F.coalesce(author, F.lit(config.default_author)).alias("author"),
        F.concat(F.lit(config.url_prefix), video_id.cast("string")).alias("url"),
        F.lit(config.location).alias("location"),
        F.to_json(F.struct(*[c.alias(n) for n, c in meta.items()])).alias("platform_metadata"),
        F.lit(config.source).alias("source"), created.alias("created_date"),
        F.coalesce(likes, F.lit(0)).cast("int").alias("likes"),
        F.lit(0).alias("comments_count"), F.lit(0).alias("shares"))


def take_until(items: DataFrame, by: Sequence[str], order: Sequence[str], size: str,
               target: int) -> DataFrame:
    """Items in order until the running size reaches the target.

    The item that crosses the target is kept. ``order`` ends in a unique column.
    """
    return prefix_sums(items, by, order, [size], until={size: target})


def target_progress(counts: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Collected, remaining and percent done per category with a target."""
    have = F.coalesce("n", F.lit(0))
    return targets.join(counts, key, "left").select(
        key, have.alias("collected"), "target",
        F.greatest(F.col("target") - have, F.lit(0)).alias("remaining"),
        F.round(F.try_divide(have * F.lit(100.0), F.col("target")), 2).alias("percent"))


def ingest_rate(posts: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Posts per minute between the first and the last post of a group."""
    minutes = (F.unix_micros(F.max(ts).cast("timestamp"))
               - F.unix_micros(F.min(ts).cast("timestamp"))) / F.lit(60e6)
    return posts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.try_divide(F.count(F.lit(1)), minutes), 6).alias("per_minute"))
