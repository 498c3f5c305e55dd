"""Merged logs, the key index, alarms and sketches over several micro-batches."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from chorus.streaming import alarms, jobs, keystore
from chorus.workspace import shared_dir


def digests(spark, values):
    return spark.createDataFrame([(v,) for v in values], "digest string")


def test_a_batch_reads_only_the_buckets_it_touches(spark):
    index = keystore.KeyIndex(spark, shared_dir(spark, "index"), buckets=16, merge_every=3)
    for i in range(5):
        index.log.merge(i)
        new = digests(spark, [f"{i}-{j}" for j in range(40)])
        assert index.known(new, i).join(new, "digest").isEmpty()
        index.add(new, i)
    asked = digests(spark, ["0-1", "3-7", "nothing"])
    buckets = {r[0] for r in asked.select(index.bucket(F.col("digest"))).collect()}
    known = index.known(asked, 5)
    files = [r[0] for r in known.select(F.input_file_name()).distinct().collect()]
    assert files and {int(re.search(r"bucket=(\d+)", f)[1]) for f in files} <= buckets
    scans = re.findall(r"PartitionFilters: \[[^\]]*bucket", known._jdf.queryExecution().toString())
    assert len(scans) >= 2  # the merged folder and the batches after it
    assert {r.digest for r in known.join(asked, "digest").collect()} == {"0-1", "3-7"}
    assert index.log.read().count() == 200


def test_reading_does_not_grow_with_the_number_of_batches(spark):
    log = keystore.BatchLog(spark, shared_dir(spark, "log"), "k string, n bigint, version bigint",
                            keystore.latest_of(["k"], ["n"]), merge_every=3)
    files = []
    for i in range(11):
        log.merge(i)
        log.write(spark.createDataFrame([("a", i, i), (f"b{i % 2}", 10 * i, i)],
                                        "k string, n bigint, version bigint").coalesce(1), i)
        files.append(log.read().select(F.input_file_name()).distinct().count())
    assert max(files) <= 3 + 1 and log.merged_upto() == 8
    assert {r.k: r.n for r in log.combine(log.read()).collect()} == {"a": 10, "b0": 100, "b1": 90}


def test_a_repeated_batch_changes_nothing(spark):
    """A batch sees neither what its first attempt wrote nor merges that hold it."""
    index = keystore.KeyIndex(spark, shared_dir(spark, "repeat"), buckets=4, merge_every=1)
    for i in range(3):
        index.log.merge(i)
        index.add(digests(spark, [f"{i}"]), i)
    index.log.merge(3)
    assert index.log.merged_upto() == 2
    for _ in range(2):
        known = {r[0] for r in index.known(digests(spark, ["0", "1", "2"]), 2).collect()}
        assert known == {"0", "1"}
        index.add(digests(spark, ["2"]), 2)


@pytest.fixture()
def posts_folder(spark):
    """Five files with keys that repeat within and across them, and rows without a key."""
    base, rows, rng = shared_dir(spark, "posts-input"), [], random.Random(2)
    for i in range(5):
        part = [(100 * i + j, None if rng.random() < 0.1 else f"k{rng.randint(0, 120)}") for j in range(100)]
        rows += part
        spark.createDataFrame(part, "id bigint, key string").coalesce(1).write.mode("append").parquet(
            f"{base}/posts.parquet")
    return base, rows


def test_insert_over_five_batches_keeps_each_key_once(spark, posts_folder):
    base, rows = posts_folder
    path, checkpoint = shared_dir(spark, "posts-out"), shared_dir(spark, "posts-chk")
    run = lambda: jobs.insert_stream(jobs.read_stream(spark, base, "posts", files_per_batch=1), path,
                                     checkpoint, "key", "id", buckets=8, merge_every=2)
    run()
    got = spark.read.parquet(path).collect()
    assert len({r.batch for r in got}) == 5
    keys = [r.key for r in got if r.key is not None]
    assert sorted(keys) == sorted({k for _, k in rows if k is not None})
    assert sum(r.key is None for r in got) == sum(k is None for _, k in rows)
    run()
    assert spark.read.parquet(path).count() == len(got)


def brute_silences(rows, span, watermark):
    found, by = set(), {}
    for source, at in rows:
        by.setdefault(source, set()).add(at)
    for source, times in by.items():
        for at in times:
            if at + span < watermark and not any(at < t <= at + span for t in times):
                found.add((source, at))
    return found


def test_alarms_do_not_depend_on_the_batches(spark):
    rng, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = sorted((rng.randint(0, 7200), rng.choice(["a", "a", "a", "b"])) for _ in range(150))
    rows = [(s, start + dt.timedelta(seconds=t)) for t, s in rows] + [(None, start), ("a", None)]
    base = shared_dir(spark, "alarm-input")
    for i in range(4):  # each file overlaps the next by less than the delay
        part = rows[i * 38:(i + 1) * 38]
        rng.shuffle(part)
        spark.createDataFrame(part, "source string, ts timestamp").coalesce(1).write.mode("append").parquet(
            f"{base}/entries.parquet")
    stream = jobs.read_stream(spark, base, "entries", files_per_batch=1)
    found = jobs.run_to_table(alarms.silences(stream, "source", "ts", 5, "2 hours"), "alarms")
    kept = [(s, t) for s, t in rows if s and t]
    newest = max(t for _, t in kept)
    want = brute_silences(kept, dt.timedelta(minutes=5), newest - dt.timedelta(hours=2))
    assert {(r.source, r.silent_since) for r in found.collect()} == want
    again = jobs.run_to_table(alarms.silences(
        jobs.read_stream(spark, base, "entries"), "source", "ts", 5, "1 minute"), "alarms-at-once")
    want = brute_silences(kept, dt.timedelta(minutes=5), newest - dt.timedelta(minutes=1))
    assert want and sorted(map(tuple, again.collect())) == sorted(want)


def test_times_are_decided_behind_the_watermark():
    assert alarms.decided([0, 10, 400, 900], 300, 800) == ([10, 400], [900])
    assert alarms.decided([], 300, 800) == ([], [])
    assert alarms.decided([500], 300, 800) == ([], [500])


def test_sketches_merge_over_batches_within_their_error(spark):
    rng = random.Random(9)
    rows = [("k", rng.expovariate(0.01), f"p{rng.randint(0, 3000)}") for _ in range(12_000)]
    rows += [("few", 1.0, "p"), ("few", 3.0, None), ("none", None, None)]
    base = shared_dir(spark, "figures-input")
    for i in range(6):
        spark.createDataFrame(rows[i::6], "key string, ms double, person string").coalesce(1).write.mode(
            "append").parquet(f"{base}/requests.parquet")
    got = {r.key: r for r in jobs.run_to_summary(
        jobs.read_stream(spark, base, "requests", files_per_batch=1), "figures", ["key"], "ms", "person",
        merge_every=2).collect()}
    times = sorted(t for k, t, _ in rows if k == "k")
    for p in (50, 95, 99):
        rank = sum(t <= got["k"][f"p{p}"] for t in times) / len(times)
        assert abs(rank - p / 100) < 0.01
    people = len({x for k, _, x in rows if k == "k"})
    assert abs(got["k"].people - people) < 0.05 * people
    assert got["k"].requests == 12_000 and abs(got["k"]["mean"] - sum(times) / 12_000) < 1e-6
    assert (got["few"].requests, got["few"].people, got["few"].p99) == (2, 1, 3.0)
    assert got["none"].requests == 1 and got["none"].people == 0
