"""The post table: idempotent ingest, processing flags, run log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from chorus import schema
from chorus.functions import jsonmeta
from chorus.operators.ordering import dense_row_ids, prefix_sums
from chorus.workspace import stage

RAW_POST_DEFAULTS = {
    "collected_date": F.current_timestamp, "likes": 0, "comments_count": 0, "shares": 0,
    "is_processed": False,
}


def _default(column: str) -> Column:
    value = RAW_POST_DEFAULTS.get(column)
    return value() if callable(value) else F.lit(value)


def _pending(flag: str) -> Column:
    """A missing flag means not processed."""
    return ~F.coalesce(F.col(flag), F.lit(False))


def key_digest(key: Column) -> Column:
    """What stands for a key in shuffles; null stays null."""
    return F.sha2(key.cast("string"), 256)


#: How the digest of a row without a key begins.
KEYLESS = "row "


def winners(df: DataFrame, key: Column, order: str) -> DataFrame:
    """(digest, order) of the first row of each key; rows without a key have their own."""
    digest = F.coalesce(key_digest(key), F.concat(F.lit(KEYLESS), F.col(order).cast("string")))
    return df.groupBy(digest.alias("digest")).agg(F.min(order).alias(order))


def first_per_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Keep the first row (lowest ``order``, a unique column) of each key.

    Rows without a key are all kept. Only a digest of the key and the order
    column are aggregated, and copies collapse before the shuffle, so a key
    held by a large share of the rows costs no more than any other.
    """
    return df.join(winners(df, key, order).select(order), order, "left_semi")


def insert_if_absent(new: DataFrame, target: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``new`` the target does not hold yet, the first writer of each key.

    Digests of the new keys meet digests of the stored ones; the rows themselves
    are joined once, with the order values that stay.
    """
    stored = target.select(key_digest(F.col(key)).alias("digest"))
    fresh = winners(new, F.col(key), order).join(
        stored.filter(F.col("digest").isNotNull()).distinct(), "digest", "left_anti")
    return new.join(fresh.select(order), order, "left_semi")


def ingest_counts(new: DataFrame, inserted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Received, inserted and duplicate rows per group."""
    received = new.groupBy(*by).agg(F.count(F.lit(1)).alias("received"))
    kept = inserted.groupBy(*by).agg(F.count(F.lit(1)).alias("inserted"))
    return received.join(kept, list(by), "left").select(
        *by, "received", F.coalesce("inserted", F.lit(0)).alias("inserted"),
        (F.col("received") - F.coalesce("inserted", F.lit(0))).alias("duplicates"))


def count_ingest(new: DataFrame, key: Column, order: str, by: str) -> DataFrame:
    """Received, inserted and duplicate rows per group of ``by``, in one scan.

    Rows are counted per key and group before they are shuffled; the first writer of a key
    is then the group with its lowest ``order``. Rows without a key are all inserted.
    """
    digest = F.coalesce(key_digest(key), F.concat(F.lit(KEYLESS), F.col(order).cast("string")))
    counts = new.groupBy(digest.alias("_digest"), by).agg(
        F.count(F.lit(1)).alias("received"), F.min(order).alias("_first"))
    writers = Window.partitionBy("_digest")
    won = (F.col("_first") == F.min("_first").over(writers)).cast("bigint")
    return counts.withColumn("inserted", won).groupBy(by).agg(
        F.sum("received").alias("received"), F.sum("inserted").alias("inserted"),
        (F.sum("received") - F.sum("inserted")).alias("duplicates"))


def append_posts(spark: SparkSession, new: DataFrame, path: str, order: str) -> DataFrame:
    """Insert new posts into the post table at ``path``; returns what was added.

    Columns that are absent or missing take the defaults of the table; posts
    without an id take the ones after the largest stored.
    """
    target = spark.read.schema(schema.RAW_POSTS).parquet(path)
    last = target.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = dense_row_ids(insert_if_absent(new, target, "post_id", order), [order], "_row")
    own = F.col("id") if "id" in new.columns else F.lit(None)
    values = {"id": F.coalesce(own, F.col("_row") + last)}
    for f in schema.RAW_POSTS:
        if f.name != "id":
            given = F.col(f.name) if f.name in new.columns else F.lit(None)
            values[f.name] = F.coalesce(given, _default(f.name))
    added = stage(added.select(*[values[f.name].cast(f.dataType).alias(f.name)
                                 for f in schema.RAW_POSTS]), "added-posts")
    added.write.mode("append").parquet(path)
    return added


def append_processed(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Append processed posts to the table at ``path``: one per raw post, ids going on.

    ``rows`` has ``raw_post_id`` and any other columns of the table; raw posts that
    are stored already are left out. Returns what was added.
    """
    target = spark.read.schema(schema.PROCESSED_POSTS).parquet(path)
    last = target.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = rows.join(target.select("raw_post_id"), "raw_post_id", "left_anti")
    added = dense_row_ids(fresh, ["raw_post_id"], "_row")
    values = {f.name: F.col(f.name) if f.name in rows.columns else F.lit(None)
              for f in schema.PROCESSED_POSTS}
    values["id"] = F.col("_row") + last
    values["processed_date"] = F.coalesce(values["processed_date"], F.current_timestamp())
    added = stage(added.select(*[values[f.name].cast(f.dataType).alias(f.name)
                                 for f in schema.PROCESSED_POSTS]), "added-processed")
    added.write.mode("append").parquet(path)
    return added


def encode_processed(df: DataFrame, emotions: str, topics: str) -> DataFrame:
    """Store the emotion map and the topic list as JSON text."""
    return df.withColumns({emotions: F.to_json(emotions), topics: F.to_json(topics)})


def processing_stats(posts: DataFrame, flag: str = "is_processed") -> DataFrame:
    return posts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(flag)).alias("processed"),
        F.count_if(_pending(flag)).alias("pending"))


def mark_processed(posts: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Set the flag on every post whose key is in ``done``."""
    marks = done.select(key).distinct().withColumn("_done", F.lit(True))
    return (posts.join(marks, key, "left")
            .withColumn("is_processed", F.coalesce("_done", F.col("is_processed"), F.lit(False)))
            .drop("_done"))


def unprocessed(posts: DataFrame, limit: int, order: Sequence[str]) -> DataFrame:
    """The next batch of pending posts in a total order.

    The last key of the batch is found from the keys alone, part by part; a limit would bring
    all posts of the batch into one task.
    """
    pending = posts.filter(_pending("is_processed"))
    keys = pending.select(*order, F.lit(1).alias("_n"))
    last = prefix_sums(keys, [], order, ["_n"], {"_n": limit}).agg(F.max(F.struct(*order)))
    return pending.filter(F.struct(*order) <= last.scalar()).orderBy(*order)


def recent(posts: DataFrame, ts: str, minutes: int) -> DataFrame:
    """Rows of the last minutes before the newest row."""
    newest = posts.agg((F.max(ts) - F.expr(f"INTERVAL {minutes} MINUTES")).alias("since"))
    return posts.filter(F.col(ts) >= newest.scalar())


def backfill_category(posts: DataFrame, meta: str, value: str) -> DataFrame:
    """Fill blank categories in the metadata and say which rows changed."""
    return posts.withColumns({
        "changed": jsonmeta.is_blank(F.col(meta), "category") & jsonmeta.settable(F.col(meta)),
        meta: jsonmeta.backfill(F.col(meta), "category", value)})


def append_log(runs: DataFrame, path: str) -> DataFrame:
    """Append run rows to the log table at ``path`` and return the table."""
    aligned = runs.select(*[F.col(f.name).cast(f.dataType).alias(f.name)
                            for f in schema.COLLECTION_STATS])
    aligned.write.mode("append").parquet(path)
    return runs.sparkSession.read.schema(schema.COLLECTION_STATS).parquet(path)
