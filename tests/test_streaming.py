"""Streams over several files, restarted runs, late rows and repeated batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chorus.streaming import jobs
from chorus.workspace import shared_dir


@pytest.fixture()
def folder(spark, data):
    base = shared_dir(spark, "stream-input")
    events = spark.read.parquet(f"{data}/events.parquet")
    for i, part in enumerate(events.randomSplit([1.0, 1.0, 1.0], seed=1)):
        part.coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
    return base


def test_restart_reads_only_new_files(spark, folder, data):
    path, checkpoint = shared_dir(spark, "out"), shared_dir(spark, "chk")
    run = lambda: jobs.append_to_table(
        jobs.read_stream(spark, folder, "events", "ts").select("event_id"), path, checkpoint)
    run()
    n = spark.read.parquet(f"{data}/events.parquet").count()
    assert spark.read.parquet(path).count() == n
    run()
    assert spark.read.parquet(path).count() == n
    extra = spark.read.parquet(f"{data}/events.parquet").limit(7)
    extra.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    run()
    assert spark.read.parquet(path).count() == n + 7


def test_counts_over_several_batches_equal_batch(spark, folder):
    stream = jobs.read_stream(spark, folder, "events", "ts", files_per_batch=1)
    counts = jobs.windowed_counts(stream, "ts", "1 day", ["event_type"], "40 days")
    path = shared_dir(spark, "daily")
    jobs.write_batches(counts, path, shared_dir(spark, "daily-chk"), mode="update")
    assert spark.read.parquet(path).select("batch").distinct().count() >= 3
    now = jobs.latest(spark, path, ["window_start", "event_type"], ["n"])
    table = spark.read.parquet(f"{folder}/events.parquet")
    want = table.groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("d"), "event_type").count()
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, want.collect()))


def test_duplicates_over_batches_are_dropped(spark, folder, data):
    again = spark.read.parquet(f"{folder}/events.parquet")
    again.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    stream = jobs.read_stream(spark, folder, "events", "ts", files_per_batch=1)
    kept = jobs.deduplicate(stream, "event_id", "ts", "40 days")
    table = jobs.run_to_table(kept.select("event_id"), "dedup")
    ids = [r.event_id for r in table.collect()]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{data}/events.parquet").count()


def test_insert_stream_keeps_the_first_writer(spark, folder, data):
    path, checkpoint = shared_dir(spark, "insert"), shared_dir(spark, "insert-chk")

    def run():
        stream = jobs.read_stream(spark, folder, "events", files_per_batch=1)
        jobs.insert_stream(stream.select("event_id", "event_type", "value"), path, checkpoint,
                           "event_id", "event_id")
        return spark.read.parquet(path)

    n = spark.read.parquet(f"{data}/events.parquet").count()
    assert run().count() == n
    again = spark.read.parquet(f"{folder}/events.parquet").withColumn("value", F.lit(-1.0))
    again.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    after = run()
    assert after.count() == n and after.filter("value = -1").count() == 0


def test_late_rows_leave_after_the_watermark(spark):
    base = shared_dir(spark, "late")
    for day in ("2024-01-10", "2024-01-01", "2024-01-10"):
        spark.sql(f"SELECT 'a' AS event_type, TIMESTAMP '{day} 00:00:00' AS ts").coalesce(1) \
            .write.mode("append").parquet(f"{base}/events.parquet")
    stream = jobs.read_stream(spark, base, "events", "ts", files_per_batch=1)
    counts = jobs.windowed_counts(stream, "ts", "1 day", ["event_type"], "1 day")
    path = shared_dir(spark, "late-out")
    jobs.write_batches(counts, path, shared_dir(spark, "late-chk"), mode="update")
    now = {str(r.window_start)[:10]: r.n for r in jobs.latest(
        spark, path, ["window_start", "event_type"], ["n"]).collect()}
    assert now["2024-01-10"] == 2


def test_stalled_sources(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01 10:00:00'), "
                     "('b', TIMESTAMP '2024-01-01 09:50:00') AS t(source, ts)")
    assert [r.source for r in jobs.stalled(rows, rows, "source", "ts", 5).collect()] == ["b"]
