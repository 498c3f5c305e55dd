"""Named queries: streaming jobs run to the end of the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorus.catalog.registry import query
from chorus.catalog.training import features, fitted
from chorus.plans import models
from chorus.sources.tables import load
from chorus.streaming import alarms, jobs
from chorus.workspace import shared_dir, stage

DELAY = "31 days"


@query("""SELECT text_digest, min(doc_id) AS doc_id FROM (SELECT doc_id, md5(text) AS text_digest
  FROM documents) GROUP BY text_digest""")
def stream_ingest(spark, d):
    """Documents arrive as a stream of posts keyed by a digest; each key is stored once."""
    docs = jobs.read_stream(spark, d, "documents").select(
        "doc_id", F.md5("text").alias("text_digest"))
    path = shared_dir(spark, "stream-ingest")
    jobs.insert_stream(docs, path, shared_dir(spark, "stream-ingest-checkpoint"),
                       "text_digest", "doc_id")
    return spark.read.parquet(path).drop("batch")


@query("SELECT event_id, event_type, value FROM events")
def stream_append(spark, d):
    """The endless poll-and-append loop as a stream to a Parquet table."""
    events = jobs.read_stream(spark, d, "events", "ts")
    return jobs.run_to_table(events.select("event_id", "event_type", "value"), "stream-append")


@query("SELECT event_id, event_type FROM events")
def stream_dedup(spark, d):
    """The events arrive twice; each is kept once."""
    once = jobs.read_stream(spark, d, "events", "ts").select("event_id", "event_type", "ts")
    again = jobs.read_stream(spark, d, "events", "ts").select("event_id", "event_type", "ts")
    kept = jobs.deduplicate(once.union(again), "event_id", "ts", DELAY)
    return jobs.run_to_table(kept.select("event_id", "event_type"), "stream-dedup")


@query("""SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_recent_counts(spark, d):
    counts = jobs.windowed_counts(jobs.read_stream(spark, d, "events", "ts"), "ts", "5 minutes",
                                  ["event_type"], DELAY)
    now = jobs.run_to_latest(counts, "stream-recent", ["window_start", "event_type"], ["n"])
    return now.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_daily_counts(spark, d):
    counts = jobs.windowed_counts(jobs.read_stream(spark, d, "events", "ts"), "ts", "1 day",
                                  ["event_type"], DELAY)
    now = jobs.run_to_latest(counts, "stream-daily", ["window_start", "event_type"], ["n"])
    return now.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""SELECT event_type FROM events GROUP BY event_type
HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE""")
def stalled_sources(spark, d):
    """Sources without a new entry in the last five minutes of the ingested table."""
    events = jobs.read_stream(spark, d, "events", "ts").select("event_type", "ts")
    table = jobs.run_to_table(events, "stream-stalled")
    return jobs.stalled(table, load(spark, d, "events"), "event_type", "ts", 5)


_SILENCES = """SELECT event_type AS source, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS silent_since FROM (
  SELECT event_type, ts, lead(ts) OVER (PARTITION BY event_type ORDER BY ts) AS following,
    max(ts) OVER () AS newest FROM (SELECT DISTINCT event_type, date_trunc('milliseconds', ts) AS ts FROM events))
WHERE (following IS NULL OR following > ts + INTERVAL 5 MINUTE)
  AND ts + INTERVAL 5 MINUTE < newest - INTERVAL 1 MINUTE"""


@query(_SILENCES)
def stream_silences(spark, d):
    """Entries that no other one of their source followed within five minutes, by timers."""
    events = jobs.read_stream(spark, d, "events", "ts")
    found = jobs.run_to_table(alarms.silences(events, "event_type", "ts", 5, "1 minute"), "stream-silences")
    return found.select("source", F.date_format("silent_since", "yyyy-MM-dd HH:mm:ss.SSS")
                        .alias("silent_since"))


@query("""SELECT event_type, count(*) AS requests, round(avg(value), 6) AS mean, true AS p95_near,
  true AS p99_near, true AS people_near FROM events GROUP BY event_type""")
def stream_figures(spark, d):
    """Running mean, percentiles and distinct people from mergeable sketches, held to exact ones.

    Percentiles must have a rank within one percent, distinct counts lie within five percent.
    """
    figures = jobs.run_to_summary(jobs.read_stream(spark, d, "events"), "stream-figures",
                                  ["event_type"], "value", "user_id")
    exact = load(spark, d, "events").join(stage(figures, "stream-figures"), "event_type").groupBy(
        "event_type", "requests", "mean", "people").agg(
        *[F.avg((F.col("value") <= F.col(p)).cast("int")).alias(f"upto_{p}") for p in ("p95", "p99")],
        *[F.avg((F.col("value") < F.col(p)).cast("int")).alias(f"below_{p}") for p in ("p95", "p99")],
        F.count_distinct("user_id").alias("exact_people"))
    near = lambda p, share: ((F.col(f"upto_{p}") >= share - 0.01) & (F.col(f"below_{p}") <= share + 0.01))
    return exact.select("event_type", "requests", F.round("mean", 6).alias("mean"),
                        near("p95", 0.95).alias("p95_near"), near("p99", 0.99).alias("p99_near"),
                        (F.abs(F.col("people") - F.col("exact_people")) <= 0.05 * F.col("exact_people"))
                        .alias("people_near"))


@query("""SELECT event_id, user_id FROM events WHERE user_id NOT IN
(SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)""")
def stream_unseen(spark, d):
    seen = load(spark, d, "events").filter((F.col("event_type") == "purchase") & (F.col("value") > 100))
    fresh = jobs.unseen(jobs.read_stream(spark, d, "events"), seen, "user_id")
    return jobs.run_to_table(fresh.select("event_id", "user_id"), "stream-unseen")


@query("""SELECT event_type, count(*) AS requests, round(sum(value) / count(*), 6) AS mean_ms
FROM events GROUP BY event_type""")
def stream_latency(spark, d):
    totals = jobs.running_latency(jobs.read_stream(spark, d, "events"), ["event_type"], "value")
    now = jobs.run_to_latest(totals, "stream-latency", ["event_type"], ["requests", "total"])
    return now.select("event_type", "requests", F.round(
        jobs.mean_latency(F.col("total"), F.col("requests")), 6).alias("mean_ms"))


@query()
def stream_score(spark, d):
    """Each micro-batch of conversation turns is scored and written once."""
    f = features(spark, d)
    model = fitted(spark, d, "naive_bayes")
    turns = jobs.read_stream(spark, d, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("request_id"), "text")
    path = shared_dir(spark, "stream-score")
    jobs.write_batches(
        turns, path, shared_dir(spark, "stream-score-checkpoint"),
        work=lambda batch: models.score_texts(model, f, batch, "text", "request_id"))
    return spark.read.parquet(path).drop("batch")
