"""Named queries: scans, sinks, ingest, metadata, collection."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus import schema
from chorus.catalog.derive import EVENT_POSTS, event_posts, lit
from chorus.catalog.registry import query
from chorus.functions import jsonmeta
from chorus.operators import ordering
from chorus.operators.split import stratified_split
from chorus.sources import collector, csvsplit, posts, tables
from chorus.sources.tables import load
from chorus.workspace import shared_dir

PROCESSED = """processed AS (SELECT d.doc_id, d.source, d.text, d.lang,
  l.doc_id IS NOT NULL AS is_processed FROM documents d LEFT JOIN labels l USING (doc_id))"""


def flagged_documents(spark, d):
    """Documents with the flag set where a label exists."""
    docs = load(spark, d, "documents").withColumn("is_processed", F.lit(False))
    return posts.mark_processed(docs, load(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, source, lang, text FROM documents WHERE source = 'src1'")
def export_posts(spark, d):
    return tables.export_posts(load(spark, d, "documents"), "src1",
                               ["doc_id", "source", "lang", "text"], ["doc_id"])


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_roundtrip(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = shared_dir(spark, "csv")
    tables.write_csv(docs, path)
    return tables.read_csv(spark, path, docs.schema)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_split_roundtrip(spark, d):
    """Documents written as CSV and read by tasks that see only a part of a file each."""
    docs = load(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = shared_dir(spark, "csv")
    tables.write_csv(docs, path)
    return csvsplit.read_csv(spark, path, docs.schema)


@query("""WITH fresh AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
  FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text))
SELECT doc_id, source FROM fresh WHERE rn = 1""")
def ingest_dedup(spark, d):
    """Documents as incoming posts keyed by text; benchmark texts are already stored."""
    stored = load(spark, d, "benchmark").select("text")
    new = load(spark, d, "documents").select("doc_id", "source", "text")
    return posts.insert_if_absent(new, stored, "text", "doc_id").select("doc_id", "source")


@query("""WITH fresh AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
SELECT source, count(*) AS received, count(*) FILTER (rn = 1) AS inserted,
  count(*) FILTER (rn > 1) AS duplicates FROM fresh GROUP BY source""")
def ingest_counts(spark, d):
    new = load(spark, d, "documents").select("doc_id", "source", "text")
    return posts.count_ingest(new, F.col("text"), "doc_id", "source")


@query("""SELECT c.conv_id, c.turn, c.role AS emotion, CAST(length(c.text) AS VARCHAR) AS strength,
  c.role AS topic FROM conversations c""")
def json_encode(spark, d):
    rows = load(spark, d, "conversations").select(
        "conv_id", "turn", "role",
        F.create_map(F.col("role"), F.length("text")).alias("emotion_scores"),
        F.array(F.col("role"), F.col("conv_id").cast("string")).alias("topics"))
    stored = posts.encode_processed(rows, "emotion_scores", "topics")
    emotion = F.map_keys(F.from_json("emotion_scores", "map<string,int>"))[0]
    return stored.select(
        "conv_id", "turn", emotion.alias("emotion"),
        F.from_json("emotion_scores", "map<string,string>")[F.col("role")].alias("strength"),
        F.get_json_object("topics", "$[0]").alias("topic"))


@query("""WITH runs AS (SELECT event_type AS source, CAST(ts AS DATE) AS collection_date,
    count(*) AS posts, count(*) FILTER (value > 100) AS errors,
    epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM events GROUP BY ALL)
SELECT source, count(*) AS runs, CAST(sum(posts) AS BIGINT) AS posts_collected,
  CAST(sum(errors) AS BIGINT) AS errors_count,
  round(sum(micros / 1e6), 3) AS seconds FROM runs GROUP BY source""")
def collection_log(spark, d):
    events = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    runs = events.groupBy(F.col("event_type").alias("source"),
                          F.to_date("ts").alias("collection_date")).agg(
        F.count(F.lit(1)).alias("posts_collected"),
        F.count_if(F.col("value") > 100).alias("errors_count"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6)
        .alias("collection_duration_seconds"),
        F.lit("daily run").alias("notes"))
    log = posts.append_log(runs, shared_dir(spark, "collection-log"))
    return log.groupBy("source").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("posts_collected").alias("posts_collected"),
        F.sum("errors_count").alias("errors_count"),
        F.round(F.sum("collection_duration_seconds"), 3).alias("seconds"))


@query("""WITH r AS (SELECT doc_id, lang,
    row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rn,
    count(*) OVER (PARTITION BY lang) AS n FROM documents),
  s AS (SELECT lang, CASE WHEN rn <= (n * 80) // 100 THEN 'train'
    WHEN rn <= (n * 90) // 100 THEN 'val' ELSE 'test' END AS split FROM r)
SELECT split, lang, count(*) AS n FROM s GROUP BY ALL""")
def split_write(spark, d):
    """Write the splits as partitioned files and count what is read back."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "text")
    path = shared_dir(spark, "splits")
    tables.write_splits(stratified_split(docs, "doc_id", "lang"), path)
    columns = T.StructType([*docs.schema.fields, T.StructField("split", T.StringType())])
    return (spark.read.schema(columns).parquet(path).groupBy("split", "lang")
            .agg(F.count(F.lit(1)).alias("n")))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
WHERE json_extract_string(props, '$.k') = '69'""")
def json_filter(spark, d):
    return load(spark, d, "events").filter(
        jsonmeta.field_equals(F.col("props"), "k", "69")).select(
        "event_id", jsonmeta.field(F.col("props"), "k").cast("bigint").alias("k"))


@query(f"""WITH {EVENT_POSTS} SELECT event_type, count(*) AS n FROM event_posts
WHERE metadata LIKE '%"category": "purchase"%' OR metadata LIKE '%"category":"purchase"%' GROUP BY event_type""")
def json_like(spark, d):
    hits = event_posts(spark, d).filter(
        jsonmeta.field_in_text(F.col("metadata"), "category", "purchase"))
    return hits.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVENT_POSTS} SELECT event_id, event_type FROM event_posts
WHERE coalesce(json_extract_string(metadata, '$.category'), '') = ''""")
def json_uncategorized(spark, d):
    return event_posts(spark, d).filter(
        jsonmeta.is_blank(F.col("metadata"), "category")).select("event_id", "event_type")


@query(f"""WITH {EVENT_POSTS} SELECT event_id,
  coalesce(nullif(json_extract_string(metadata, '$.category'), ''), 'unemployment') AS category,
  json_extract_string(metadata, '$.video_id') AS video_id,
  coalesce(json_extract_string(metadata, '$.category'), '') = '' AS changed FROM event_posts""")
def json_backfill(spark, d):
    done = posts.backfill_category(event_posts(spark, d), "metadata", "unemployment")
    return done.select("event_id", jsonmeta.field(F.col("metadata"), "category").alias("category"),
                       jsonmeta.field(F.col("metadata"), "video_id").alias("video_id"), "changed")


@query(f"WITH {PROCESSED} SELECT doc_id, source, is_processed FROM processed")
def mark_processed(spark, d):
    return flagged_documents(spark, d).select("doc_id", "source", "is_processed")


@query(f"""WITH {PROCESSED} SELECT doc_id, source FROM processed WHERE NOT is_processed
ORDER BY doc_id LIMIT 100""")
def unprocessed_batch(spark, d):
    return posts.unprocessed(flagged_documents(spark, d), 100, ["doc_id"]).select(
        "doc_id", "source")


@query("""SELECT event_id, event_type FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE""")
def recent_entries(spark, d):
    return posts.recent(load(spark, d, "events"), "ts", 5).select("event_id", "event_type")


@query("""SELECT 'youtube_' || conv_id || '_' || turn AS post_id, left(text, 1000) AS text,
  coalesce(nullif(role, 'system'), 'Unknown') AS author,
  'https://www.youtube.com/watch?v=' || conv_id AS url, 'India' AS location,
  '{"video_id":"' || conv_id || '","category":"' || role || '"}' AS metadata, 'youtube' AS source,
  strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id % 1000 AS INTEGER))
    + to_seconds(CAST(turn % 60 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS created_date,
  CAST(turn % 7 AS INTEGER) AS likes, 0 AS comments_count, 0 AS shares
FROM conversations WHERE length(text) >= 20""")
def comment_normalize(spark, d):
    shaped = collector.shape_comments(
        load(spark, d, "conversations"),
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")),
        F.col("conv_id"), F.nullif(F.col("role"), F.lit("system")),
        {"video_id": F.col("conv_id").cast("string"), "category": F.col("role")},
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") % 1000 * 60 + F.col("turn") % 60),
        F.col("turn") % 7)
    return shaped.withColumnRenamed("platform_metadata", "metadata").withColumn(
        "created_date", F.date_format("created_date", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH videos AS (SELECT conv_id, count(*) FILTER (role = 'user') AS comment_count
    FROM conversations GROUP BY conv_id),
  seen AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system')
SELECT conv_id, comment_count FROM videos WHERE comment_count > 0
  AND conv_id NOT IN (SELECT conv_id FROM seen) ORDER BY comment_count DESC, conv_id LIMIT 50""")
def video_candidates(spark, d):
    turns = load(spark, d, "conversations")
    videos = turns.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("comment_count"))
    seen = turns.filter(F.col("role") == "system")
    return collector.video_candidates(videos, seen, "conv_id", "comment_count", 50)


@query("""SELECT d.doc_id, d.source, d.lang, l.quality, l.toxic,
  l.doc_id IS NOT NULL AS has_label FROM documents d LEFT JOIN labels l USING (doc_id)""")
def posts_with_labels(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", "lang")
    marks = load(spark, d, "labels").withColumn("_has", F.lit(True))
    return docs.join(marks, "doc_id", "left").select(
        "doc_id", "source", "lang", "quality", "toxic",
        F.coalesce("_has", F.lit(False)).alias("has_label"))


@query("""SELECT event_id, user_id FROM events WHERE user_id NOT IN
(SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100)""")
def unseen_items(spark, d):
    events = load(spark, d, "events")
    seen = events.filter((F.col("event_type") == "purchase") & (F.col("value") > 100))
    return collector.unseen(events.select("event_id", "user_id"), seen, "user_id").select(
        "event_id", "user_id")


@query(f"""WITH {EVENT_POSTS} SELECT DISTINCT json_extract_string(metadata, '$.video_id') AS video_id
FROM event_posts WHERE json_extract_string(metadata, '$.video_id') IS NOT NULL""")
def distinct_json_ids(spark, d):
    ids = event_posts(spark, d).select(jsonmeta.field(F.col("metadata"), "video_id").alias("video_id"))
    return ids.filter(F.col("video_id").isNotNull()).distinct()


@query("""WITH o AS (SELECT event_id, event_type, ts, CAST(round(value * 100) AS BIGINT) AS cents,
    coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
SELECT event_id, event_type, cents, CAST(before AS BIGINT) AS before FROM o WHERE before < 500000""")
def quota_prefix(spark, d):
    events = load(spark, d, "events").select(
        "event_id", "event_type", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    taken = collector.take_until(events, ["event_type"], ["ts", "event_id"], "cents", 500000)
    return taken.select("event_id", "event_type", "cents", F.col("before_cents").alias("before"))


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
  t AS (SELECT * FROM (VALUES ('click', 3000), ('view', 1500), ('signup', 2500), ('share', 100))
        AS t(event_type, target))
SELECT t.event_type, coalesce(n, 0) AS collected, CAST(target AS BIGINT) AS target,
  greatest(target - coalesce(n, 0), 0) AS remaining,
  round(coalesce(n, 0) * 100.0 / target, 2) AS percent FROM t LEFT JOIN c USING (event_type)""")
def target_progress(spark, d):
    counts = load(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    targets = spark.createDataFrame(
        [("click", 3000), ("view", 1500), ("signup", 2500), ("share", 100)],
        "event_type string, target bigint")
    return collector.target_progress(counts, targets, "event_type")


@query("""SELECT event_type, count(*) AS n,
  round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6), 6) AS per_minute
FROM events GROUP BY event_type""")
def ingest_rate(spark, d):
    return collector.ingest_rate(load(spark, d, "events"), ["event_type"], "ts")


@query("""SELECT row_number() OVER (ORDER BY source, doc_id) AS row_id, doc_id, source
FROM documents""")
def surrogate_key(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source")
    return ordering.dense_row_ids(docs, ["source", "doc_id"])


@query("""WITH e AS (SELECT md5(text) AS post_id, min(doc_id) AS m FROM documents
    WHERE doc_id % 2 = 0 GROUP BY 1),
  o AS (SELECT md5(text) AS post_id, min(doc_id) AS m FROM documents
    WHERE md5(text) NOT IN (SELECT post_id FROM e) GROUP BY 1),
  stored AS (SELECT row_number() OVER (ORDER BY m) AS id, post_id, m FROM e
    UNION ALL SELECT (SELECT count(*) FROM e) + row_number() OVER (ORDER BY m), post_id, m FROM o),
  done AS (SELECT id AS raw_post_id, row_number() OVER (ORDER BY id) AS processed_id FROM stored
    WHERE id % 3 = 0)
SELECT id, post_id, m AS doc_id, CAST(0 AS INTEGER) AS likes, id % 3 = 0 AS is_processed, processed_id
FROM stored LEFT JOIN done ON raw_post_id = id""")
def append_then_fetch(spark, d):
    """Create the tables, append twice, process some posts and join both tables."""
    paths = tables.create_tables(spark, shared_dir(spark, "posts"))
    docs = load(spark, d, "documents").select(
        "doc_id", "source", "text", F.md5("text").alias("post_id"),
        F.col("doc_id").cast("string").alias("location"))
    posts.append_posts(spark, docs.filter("doc_id % 2 = 0"), paths["raw_posts"], "doc_id")
    posts.append_posts(spark, docs, paths["raw_posts"], "doc_id")
    stored = tables.read_table(spark, paths["raw_posts"], schema.RAW_POSTS)
    pending = posts.unprocessed(stored, stored.count(), ["id"])
    done = pending.filter("id % 3 = 0").select(
        F.col("id").alias("raw_post_id"), F.trim("text").alias("cleaned_text"))
    posts.append_processed(spark, done, paths["processed_posts"])
    processed = tables.read_table(spark, paths["processed_posts"], schema.PROCESSED_POSTS).select(
        "raw_post_id", F.col("id").alias("processed_id"))
    marked = posts.mark_processed(
        stored, processed.select(F.col("raw_post_id").alias("id")), "id")
    return marked.join(processed, F.col("id") == F.col("raw_post_id"), "left").select(
        "id", "post_id", F.col("location").cast("bigint").alias("doc_id"), "likes", "is_processed",
        "processed_id")


_METADATA = ('{"likes":5,"test":true,"n":{"a":[1,2.5]}}', '{"likes":"5","category":""}', "not json", "[1]",
             '{"category":"kept"}')


@query(f"""WITH m AS (SELECT doc_id, ([{', '.join(lit(x) for x in _METADATA)}])[(doc_id % 5 + 1)::INT] AS t
  FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN 'new' WHEN doc_id % 5 = 4 THEN 'kept' END AS category,
  CASE doc_id % 5 WHEN 0 THEN '5' WHEN 1 THEN '"5"' END AS likes,
  CASE doc_id % 5 WHEN 0 THEN 'true' END AS test, CASE doc_id % 5 WHEN 0 THEN '{{"a":[1,2.5]}}' END AS n,
  CASE WHEN doc_id % 5 IN (2, 3) THEN t END AS untouched, doc_id % 5 IN (0, 1) AS changed FROM m""")
def json_backfill_types(spark, d):
    """Numbers, booleans and nested values keep their type; what is no object stays."""
    texts = F.array(*[F.lit(x) for x in _METADATA])
    rows = load(spark, d, "documents").select(
        "doc_id", F.element_at(texts, (F.col("doc_id") % 5 + 1).cast("int")).alias("metadata"))
    done = posts.backfill_category(rows, "metadata", "new")
    typed = F.from_json("metadata", "map<string,variant>")
    value = lambda k: F.to_json(F.try_element_at(typed, F.lit(k)))
    return done.select(
        "doc_id", jsonmeta.field(F.col("metadata"), "category").alias("category"),
        value("likes").alias("likes"), value("test").alias("test"), value("n").alias("n"),
        F.when(typed.isNull(), F.col("metadata")).alias("untouched"), "changed")
