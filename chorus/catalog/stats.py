"""Named queries: aggregates, profiles, splits, samples, request logs, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorus.catalog.derive import EVENT_POSTS, SQL_SPACES, event_posts
from chorus.catalog.features import LEXICON, learnt_lexicon
from chorus.catalog.ingest import PROCESSED, flagged_documents
from chorus.catalog.registry import query
from chorus.catalog.text import TOKENS
from chorus.functions import jsonmeta
from chorus.operators import lexicon, ordering, profile, quality, requestlog, sequences, split, trend
from chorus.sources import posts
from chorus.sources.tables import load, write_splits
from chorus.workspace import shared_dir

LANGS = ("de", "en", "es", "fr")
KINDS = ("click", "error", "purchase", "signup", "view")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_by_source(spark, d):
    return profile.count_by(load(spark, d, "documents"), "source")


@query(f"""WITH {PROCESSED} SELECT count(*) AS total, count(*) FILTER (is_processed) AS processed,
count(*) FILTER (NOT is_processed) AS pending FROM processed""")
def processing_stats(spark, d):
    return posts.processing_stats(flagged_documents(spark, d))


@query("SELECT 'src1' AS source, count(*) AS n FROM documents WHERE source = 'src1'")
def source_count(spark, d):
    rows = load(spark, d, "documents").filter(F.col("source") == "src1")
    return rows.agg(F.lit("src1").alias("source"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVENT_POSTS} SELECT coalesce(json_extract_string(metadata, '$.category'), 'None/NULL')
  AS category, count(*) AS n FROM event_posts GROUP BY 1 ORDER BY n DESC""")
def json_category_counts(spark, d):
    category = F.coalesce(jsonmeta.field(F.col("metadata"), "category"), F.lit("None/NULL"))
    return profile.count_by(event_posts(spark, d), category.alias("category")).orderBy(
        F.desc("n"), "category")


@query("""SELECT event_type, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest
FROM events GROUP BY event_type""")
def latest_by_source(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("""SELECT count(*) AS n, count(DISTINCT user_id) AS authors,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_date,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_date FROM events""")
def export_stats(spark, d):
    return load(spark, d, "events").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("authors"),
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_date"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_date"))


@query("""WITH j AS (SELECT d.doc_id, d.source, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'doc_id' AS column_name, count(*) - count(doc_id) AS nulls FROM j
UNION ALL SELECT 'source', count(*) - count(source) FROM j
UNION ALL SELECT 'quality', count(*) - count(quality) FROM j
UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM j""")
def null_profile(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source")
    return profile.null_profile(docs.join(load(spark, d, "labels"), "doc_id", "left"))


@query("""SELECT lang, count(*) AS n,
  round(count(*) * 100.0 / (SELECT count(*) FROM documents WHERE lang IS NOT NULL), 2) AS percent
FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def class_distribution(spark, d):
    return profile.distribution(load(spark, d, "documents"), "lang")


@query("SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{c}') AS {c}" for c in LANGS)
       + f", count(*) FILTER (lang IS NULL OR lang NOT IN {LANGS}) AS other FROM documents GROUP BY source")
def crosstab(spark, d):
    return profile.crosstab(load(spark, d, "documents"), "source", "lang", LANGS)


@query("""SELECT source, lang, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY source), 2) AS percent
FROM documents GROUP BY source, lang""")
def crosstab_pct(spark, d):
    return profile.crosstab_percent(load(spark, d, "documents"), "source", "lang")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL""")
def pair_counts(spark, d):
    return profile.count_by(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def monthly_counts(spark, d):
    return profile.count_by(load(spark, d, "orders"), profile.month("o_orderdate").alias("month"))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (o_orderstatus = 'F') AS "F",
  count(*) FILTER (o_orderstatus = 'O') AS "O",
  count(*) FILTER (o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')) AS other
FROM orders GROUP BY 1""")
def monthly_by_class(spark, d):
    orders = load(spark, d, "orders").select(
        profile.month("o_orderdate").alias("month"), "o_orderstatus")
    return profile.crosstab(orders, "month", "o_orderstatus", ("F", "O"))


@query("""SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean,
  round(stddev_samp(l_extendedprice), 4) AS std, round(median(l_extendedprice), 4) AS median
FROM lineitem GROUP BY l_returnflag""")
def numeric_summary(spark, d):
    return profile.numeric_summary(load(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("""SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price,
  round(corr(l_discount, l_tax), 6) AS discount_tax FROM lineitem""")
def score_correlation(spark, d):
    return load(spark, d, "lineitem").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("quantity_price"),
        F.round(F.corr("l_discount", "l_tax"), 6).alias("discount_tax"))


@query("""WITH v AS (SELECT event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)
SELECT event_type, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std,
  round(median(v), 4) AS median FROM v GROUP BY 1""")
def numeric_summary_nan(spark, d):
    """Every seventh value is NaN and counts as missing."""
    events = load(spark, d, "events").withColumn(
        "value", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")))
    return profile.numeric_summary(events, ["event_type"], "value")


@query("""WITH lim AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
  c AS (SELECT CAST(least(floor((value - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS n
    FROM events, lim GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS n, lo + (hi - lo) * r.range / 50 AS low
FROM range(50) r LEFT JOIN c ON c.bin = r.range, lim""")
def histogram(spark, d):
    return profile.histogram(load(spark, d, "events"), "value", 50)


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5)
    AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
  max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
FROM events JOIN q USING (event_type) GROUP BY event_type, q1, median, q3""")
def box_stats(spark, d):
    box = profile.box_stats(load(spark, d, "events"), ["event_type"], "value")
    return box.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(f"""WITH {LEXICON}, j AS (SELECT n_chars, vader_compound FROM documents JOIN scored USING (doc_id)),
  lim AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM j)
SELECT CAST(least(floor(CAST(n_chars - lo AS DOUBLE) / (hi - lo) * 20), 19) AS INTEGER) AS bin,
  count(*) AS n, round(avg(n_chars), 4) AS mean_x, round(avg(vader_compound), 6) AS mean_y
FROM j, lim GROUP BY 1""")
def length_trend(spark, d):
    """Length against the compound score of every document."""
    scored = lexicon.lexicon_sentiment(load(spark, d, "documents").select("doc_id", "text"), "doc_id",
                                       "text", learnt_lexicon(spark, d))
    both = load(spark, d, "documents").select("doc_id", "n_chars").join(scored, "doc_id")
    return profile.binned_trend(both, "n_chars", "vader_compound", 20)


@query(f"""WITH j AS (SELECT CAST(n_chars AS DOUBLE) AS x,
    CAST(len(text) - len(replace(text, ' ', '')) AS DOUBLE) AS y FROM documents),
  lim AS (SELECT min(x) AS lo, max(x) AS hi FROM j),
  m AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * {trend.FINE}), {trend.FINE - 1}) AS INTEGER) AS bin,
    count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy
    FROM j, lim WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1),
  e AS (SELECT min(sx / n) AS lo, max(sx / n) AS hi, CAST(sum(n) AS DOUBLE) AS all_n FROM m),
  near AS (SELECT point, lo + (hi - lo) * point / 19 AS x0, abs(sx / n - (lo + (hi - lo) * point / 19)) AS d,
    m.*, all_n FROM (SELECT unnest(range(20)) AS point), e, m),
  placed AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY point ORDER BY d, bin
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < ceil(all_n * (2 / 3)) AS inside FROM near),
  reach AS (SELECT *, max(CASE WHEN inside THEN d END) OVER (PARTITION BY point) * 1.0000001 AS h FROM placed),
  w AS (SELECT *, CASE WHEN inside THEN pow(1 - pow(least(coalesce(d / nullif(h, 0), 0), 1), 3), 3)
    ELSE 0 END AS w FROM reach),
  s AS (SELECT point, x0, sum(w * n) AS w, sum(w * sx) AS x, sum(w * sy) AS y, sum(w * sxx) AS xx,
    sum(w * sxy) AS xy FROM w GROUP BY point, x0)
SELECT CAST(point AS INTEGER) AS point, round(x0, 3) AS "at",
  round(y / w + (xy / w - x / w * y / w) / (xx / w - x / w * x / w) * (x0 - x / w), 3) AS fitted FROM s""")
def length_trend_local(spark, d):
    """Local regression of the number of blanks on the length, over all documents."""
    docs = load(spark, d, "documents").select(
        "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("blanks"))
    fitted = trend.local_trend(docs, "n_chars", "blanks")
    return fitted.select("point", F.round("at", 3).alias("at"), F.round("fitted", 3).alias("fitted"))


SPLIT = """ranked AS (SELECT doc_id, lang,
    row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rn,
    count(*) OVER (PARTITION BY lang) AS n FROM documents),
  parts AS (SELECT doc_id, lang, CASE WHEN rn <= (n * 80) // 100 THEN 'train'
    WHEN rn <= (n * 90) // 100 THEN 'val' ELSE 'test' END AS split FROM ranked)"""


def split_documents(spark, d, *columns):
    docs = load(spark, d, "documents").select("doc_id", "lang", *columns)
    return split.stratified_split(docs, "doc_id", "lang")


@query(f"WITH {SPLIT} SELECT doc_id, lang, split FROM parts")
def stratified_split(spark, d):
    return split_documents(spark, d)


@query(f"""WITH {SPLIT}, c AS (SELECT split, lang, count(*) AS n FROM parts GROUP BY ALL),
  s AS (SELECT split, lang, n, round(n * 100.0 / sum(n) OVER (PARTITION BY split), 4) AS pct FROM c),
  a AS (SELECT lang, round(sum(n) * 100.0 / (SELECT count(*) FROM parts), 4) AS pct FROM c GROUP BY lang)
SELECT split, CAST(sum(n) AS BIGINT) AS n, round(max(abs(s.pct - a.pct)), 4) AS max_deviation
FROM s JOIN a USING (lang) GROUP BY split""")
def split_quality(spark, d):
    return split.split_quality(split_documents(spark, d), "lang")


@query(f"""WITH {SPLIT} SELECT split, count(*) AS n, count(DISTINCT parts.lang) AS classes,
  CAST(sum(n_chars) AS BIGINT) AS chars FROM parts JOIN documents USING (doc_id) GROUP BY split""")
def split_union(spark, d):
    """The three written split folders put together again, each with its name."""
    path = shared_dir(spark, "split-folders")
    write_splits(split_documents(spark, d, "n_chars"), path)
    named = [spark.read.parquet(f"{path}/split={s}").withColumn("split", F.lit(s))
             for s in ("train", "val", "test")]
    both = named[0].unionByName(named[1]).unionByName(named[2])
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("classes"),
        F.sum("n_chars").alias("chars"))


@query(f"""WITH {SPLIT}, t AS (SELECT doc_id, {TOKENS} AS w FROM documents),
  known AS (SELECT count(DISTINCT word) AS words FROM (SELECT unnest(w) AS word FROM t))
SELECT split, count(*) AS n, CAST(sum(least(len(w), 128)) AS BIGINT) AS tokens, 128 AS width,
  any_value(words) AS words FROM parts JOIN t USING (doc_id), known GROUP BY split""")
def seq_dataset(spark, d):
    """Encoded documents of each split and their vocabulary, written and read back."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    vocab = sequences.vocabulary(docs, "text")
    coded = sequences.encode(docs, "doc_id", "text", vocab, length=128)
    path = shared_dir(spark, "encoded-dataset")
    sequences.save_dataset(coded.join(split_documents(spark, d).select("doc_id", "split"), "doc_id"),
                           vocab, path)
    rows, words = sequences.load_dataset(spark, path)
    kept = F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b)
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(kept).cast("bigint").alias("tokens"),
        F.max(F.size("input_ids")).alias("width")).withColumn(
        "words", words.agg(F.count(F.lit(1))).scalar())


@query("""SELECT doc_id, source, n_chars FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50""")
def seeded_sample(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", "n_chars")
    return ordering.hashed_sample(docs, 50, "doc_id", 7)


@query("""WITH ok AS (SELECT CAST(ts AS DATE) AS day, value FROM events WHERE event_type <> 'error'),
  r AS (SELECT day, value, row_number() OVER (PARTITION BY day ORDER BY value) AS rn,
    count(*) OVER (PARTITION BY day) AS n FROM ok),
  p AS (SELECT day, max(value) FILTER (rn = least((n * 95) // 100, n - 1) + 1) AS p95,
    max(value) FILTER (rn = least((n * 99) // 100, n - 1) + 1) AS p99,
    round(median(value), 4) AS median FROM r GROUP BY day),
  b AS (SELECT CAST(ts AS DATE) AS day, count(*) AS requests,
    count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed,
    round(count(*) FILTER (event_type <> 'error') / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6)
      AS throughput,
    round(avg(value) FILTER (event_type <> 'error'), 4) AS mean,
    min(value) FILTER (event_type <> 'error') AS min, max(value) FILTER (event_type <> 'error') AS max
    FROM events GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS level, requests, ok, failed, throughput, mean, min, max, median, p95, p99
FROM b LEFT JOIN p USING (day)""")
def latency_stats(spark, d):
    log = load(spark, d, "events").withColumn("level", F.date_format("ts", "yyyy-MM-dd"))
    return requestlog.latency_stats(log, ["level"], "value", F.col("event_type") == "error", "ts")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value)
    AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, any_value(n) AS n, max(value) FILTER (rn = least((n * 50) // 100, n - 1) + 1) AS p50,
  max(value) FILTER (rn = least((n * 95) // 100, n - 1) + 1) AS p95,
  max(value) FILTER (rn = least((n * 99) // 100, n - 1) + 1) AS p99 FROM r GROUP BY event_type""")
def index_percentile(spark, d):
    return requestlog.index_percentiles(load(spark, d, "events"), ["event_type"], "value",
                                        {"p50": 50, "p95": 95, "p99": 99})


@query("""SELECT conv_id % 40 AS batch, count(*) AS size, count(*) BETWEEN 1 AND 100 AS valid
FROM conversations GROUP BY ALL""")
def batch_validity(spark, d):
    """Turns in batches by conversation: whether a batch holds an allowed number of texts."""
    batches = load(spark, d, "conversations").groupBy((F.col("conv_id") % 40).alias("batch")).agg(
        F.count(F.lit(1)).alias("size"))
    return batches.withColumn("valid", quality.valid_batches(batches, "size"))


@query(f"""WITH v AS (SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'missing'
    WHEN text = '' THEN 'empty' WHEN length(text) > 5000 THEN 'too long'
    WHEN regexp_replace(text, '[{SQL_SPACES}]+', '', 'g') = '' THEN 'blank' END AS reason FROM (
    SELECT conv_id, turn, CASE role WHEN 'system' THEN repeat(' ', CAST(turn AS INTEGER) * 3)
      ELSE text END AS text FROM conversations))
SELECT coalesce(reason, 'valid') AS verdict, count(*) AS n FROM v GROUP BY 1""")
def validate_requests(spark, d):
    """Turns as requests; system turns stand in for empty and blank ones."""
    turns = load(spark, d, "conversations").withColumn(
        "text", F.when(F.col("role") == "system",
                       F.repeat(F.lit(" "), (F.col("turn") * 3).cast("int"))).otherwise(F.col("text")))
    checked = quality.validate_requests(turns, "text")
    return profile.count_by(checked, F.coalesce("reason", F.lit("valid")).alias("verdict"))


@query("""SELECT 'row_count' AS "check", count(*) AS value, true AS passed FROM documents
UNION ALL SELECT 'no_null_text', count(*) - count(text), count(*) = count(text) FROM documents
UNION ALL SELECT 'no_null_lang', count(*) - count(lang), count(*) = count(lang) FROM documents""")
def dq_checks(spark, d):
    docs = load(spark, d, "documents")
    expected = docs.select("doc_id").distinct().agg(F.count(F.lit(1)))
    return quality.export_checks(docs, expected.scalar(), ["text", "lang"])


@query("""SELECT md5(text) AS digest, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1""")
def dq_duplicates(spark, d):
    return quality.duplicate_keys(load(spark, d, "documents"), F.md5("text").alias("digest"))
