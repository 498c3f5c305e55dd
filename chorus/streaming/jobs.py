"""Continuous ingest and statistics as Structured Streaming jobs.

Every job reads new files of a table folder, works with ``availableNow`` and can
be started again on the same checkpoint: files already read are not read twice.
Sinks are idempotent, so a repeated micro-batch changes nothing. Rows older than
the watermark are dropped by the stateful jobs; state older than it is removed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from chorus.sources import posts
from chorus.streaming import keystore
from chorus.workspace import apply_settings, shared_dir, stage

SKETCH = 800  # of the quantiles: ranks within half a percent
HLL_BITS = 14  # of the distinct counts: within some two percent

# Keyed state on disk instead of in executor memory.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_stream(spark: SparkSession, base: str, table: str, ts: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    """Stream of a Parquet table, a folder or a single file, with a declared schema."""
    apply_settings(spark)
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    root = base.rstrip("/")
    reader = spark.readStream.schema(spark.read.parquet(f"{root}/{table}.parquet").schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(f"{root}/{{{table}.parquet}}")
    return stream.withColumn(ts, F.col(ts).cast("timestamp")) if ts else stream


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append the rows of a stream to a Parquet folder, each exactly once."""
    (stream.writeStream.format("parquet").outputMode("append")
     .option("path", path).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                  work: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Write each micro-batch, after ``work``, to its own folder below ``path``.

    A repeated batch overwrites its folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    (stream.writeStream.foreachBatch(write).outputMode(mode)
     .option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def insert_stream(stream: DataFrame, path: str, checkpoint: str, key: str, order: str,
                  buckets: int = keystore.BUCKETS, merge_every: int = keystore.MERGE_EVERY) -> None:
    """Insert posts whose key the table does not hold yet, the first writer wins.

    The whole table is the memory: no watermark, no row is ever too late. Copies
    inside a batch collapse before the shuffle. What the table holds is looked up in
    an index of its keys next to it, in the buckets the keys of the batch fall into.
    A repeated batch ignores and overwrites what its first attempt wrote.
    """
    index = keystore.KeyIndex(stream.sparkSession, f"{path}-keys", buckets, merge_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        index.log.merge(batch_id)
        new = stage(posts.winners(batch, F.col(key), order), "stream-keys")
        keyed = new.filter(~F.startswith("digest", F.lit(posts.KEYLESS)))
        known = index.known(keyed, batch_id)
        fresh = stage(new.join(known, "digest", "left_anti"), "stream-fresh")
        batch.join(fresh.select(order), order, "left_semi").write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}")
        index.add(fresh.filter(~F.startswith("digest", F.lit(posts.KEYLESS))), batch_id)

    stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(
        f"{path}/batch=-1")
    (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def write_changes(stream: DataFrame, log: keystore.BatchLog, checkpoint: str, mode: str = "update",
                  work: Callable[[DataFrame, int], DataFrame] = lambda df, batch_id: df) -> None:
    """Write each micro-batch, after ``work``, to a log that is merged as it grows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        log.merge(batch_id)
        log.write(work(batch, batch_id), batch_id)

    (stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def latest(spark: SparkSession, path: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Current value per key of a change log written in update mode."""
    changes = spark.read.parquet(path)
    return changes.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def run_to_table(stream: DataFrame, purpose: str) -> DataFrame:
    spark = stream.sparkSession
    path = shared_dir(spark, purpose)
    append_to_table(stream, path, shared_dir(spark, f"{purpose}-checkpoint"))
    return spark.read.parquet(path)


def change_log(spark: SparkSession, path: str, columns: T.StructType, keys: Sequence[str],
               values: Sequence[str], merge_every: int = keystore.MERGE_EVERY) -> keystore.BatchLog:
    """Log of the values of keys; merging keeps the newest of each key."""
    kinds = T.StructType([*[columns[c] for c in [*keys, *values]], T.StructField("version", T.LongType())])
    return keystore.BatchLog(spark, path, kinds, keystore.latest_of(keys, values), merge_every=merge_every)


def run_to_latest(stream: DataFrame, purpose: str, keys: Sequence[str],
                  values: Sequence[str]) -> DataFrame:
    """Run a stream in update mode and return the newest values of each key."""
    spark = stream.sparkSession
    log = change_log(spark, shared_dir(spark, purpose), stream.schema, keys, values)
    write_changes(stream, log, shared_dir(spark, f"{purpose}-checkpoint"),
                  work=lambda batch, batch_id: batch.withColumn("version", F.lit(batch_id)))
    return log.combine(log.read()).drop("version")


def summaries(keys: Sequence[str]) -> tuple[str, Callable[[DataFrame], DataFrame]]:
    """Columns and merging of running statistics with sketches, see :func:`summarised`."""
    columns = ", ".join([*[f"{k} string" for k in keys],
                         "requests bigint, total double, times binary, people binary"])

    def combine(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.sum("requests").alias("requests"), F.sum("total").alias("total"),
            F.kll_merge_agg_double("times", SKETCH).alias("times"),
            F.hll_union_agg("people").alias("people"))

    return columns, combine


def summarised(batch: DataFrame, keys: Sequence[str], latency: str, person: str) -> DataFrame:
    """Count, sum, and mergeable sketches of the latencies and of the distinct people, per key."""
    value = F.col(latency).cast("double")
    return batch.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(value).alias("total"),
        F.kll_sketch_agg_double(F.when(~F.isnan(value), value), SKETCH).alias("times"),
        F.hll_sketch_agg(F.col(person).cast("string"), HLL_BITS).alias("people"))


def running_figures(summary: DataFrame, keys: Sequence[str],
                    percents: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """Requests, mean, percentiles and distinct people from merged summaries."""
    return summary.select(
        *keys, "requests", mean_latency(F.col("total"), F.col("requests")).alias("mean"),
        *[F.when(F.kll_sketch_get_n_double("times") > 0,
                 F.kll_sketch_get_quantile_double("times", F.lit(p / 100.0))).alias(f"p{p}")
          for p in percents],
        F.hll_sketch_estimate("people").alias("people"))


def run_to_summary(stream: DataFrame, purpose: str, keys: Sequence[str], latency: str, person: str,
                   merge_every: int = keystore.MERGE_EVERY) -> DataFrame:
    """Running figures of a whole stream; each micro-batch only adds its own summary."""
    spark = stream.sparkSession
    columns, combine = summaries(keys)
    log = keystore.BatchLog(spark, shared_dir(spark, purpose), columns, combine, merge_every=merge_every)
    write_changes(stream, log, shared_dir(spark, f"{purpose}-checkpoint"), "append",
                  lambda batch, _: summarised(batch, keys, latency, person))
    return running_figures(combine(log.read()), keys)


def deduplicate(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Keep the first row of each key seen within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, width: str, by: Sequence[str],
                    delay: str) -> DataFrame:
    """Rows per time window and key."""
    return (stream.withWatermark(ts, delay).groupBy(F.window(ts, width), *by)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("window_start"), *by, "n"))


def stalled(rows: DataFrame, sources: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """Known sources without a row in the last minutes before the newest row."""
    since = rows.agg((F.max(ts) - F.expr(f"INTERVAL {minutes} MINUTES")).alias("since"))
    alive = rows.filter(F.col(ts) >= since.scalar()).select(key).distinct()
    return sources.select(key).distinct().join(alive, key, "left_anti")


def unseen(stream: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows of the stream whose key is not in a static table."""
    return stream.join(seen.select(key).distinct(), key, "left_anti")


def running_latency(stream: DataFrame, by: Sequence[str], latency: str) -> DataFrame:
    """Number of requests and summed time so far per key."""
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"),
                                   F.sum(latency).alias("total"))


def mean_latency(total: Column, requests: Column) -> Column:
    return F.coalesce(F.try_divide(total, requests), F.lit(0.0))
