from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chorus import schema
from chorus.config import RequestConfig
from chorus.functions import jsonmeta
from chorus.operators import keywords, quality
from chorus.sources import collector, posts, tables
from chorus.workspace import shared_dir


def post(n, post_id, text="some text that is long enough"):
    return (n, "youtube", post_id, text, "someone", datetime(2024, 1, 1), '{"test": true}', 10)


COLUMNS = ("id bigint, source string, post_id string, text string, author string, "
           "created_date timestamp, platform_metadata string, likes int")


def test_insert_twice_keeps_one_row(spark):
    paths = tables.create_tables(spark, shared_dir(spark, "tables"))
    tables.create_tables(spark, paths["raw_posts"].rsplit("/", 1)[0])
    batch = spark.createDataFrame([post(1, "a"), post(2, "a", "other"), post(3, "b")], COLUMNS)
    posts.append_posts(spark, batch, paths["raw_posts"], "id")
    posts.append_posts(spark, batch, paths["raw_posts"], "id")
    table = tables.read_table(spark, paths["raw_posts"], schema.RAW_POSTS)
    assert sorted((r.post_id, r.id) for r in table.collect()) == [("a", 1), ("b", 3)]


def test_missing_keys_are_all_kept(spark):
    new = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "id int, post_id string")
    target = spark.createDataFrame([("y",), (None,)], "post_id string")
    kept = posts.insert_if_absent(new, target, "post_id", "id")
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3]


def test_one_key_with_most_of_the_rows(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.col("id").cast("string")).alias("k"))
    kept = posts.first_per_key(rows, F.col("k"), "id")
    assert kept.count() == rows.select("k").distinct().count()
    assert kept.filter(F.col("k") == "hot").first().id == 0


@pytest.mark.parametrize("meta, want", [
    ('{"category": null, "a": "1"}', "unemployment"), ('{"category": ""}', "unemployment"),
    (None, "unemployment"), ('{"category": "x"}', "x"), ("{}", "unemployment")])
def test_category_backfill(spark, meta, want):
    row = spark.createDataFrame([(meta,)], "m string")
    done = posts.backfill_category(row, "m", "unemployment").select(
        jsonmeta.field(F.col("m"), "category").alias("c"), jsonmeta.field(F.col("m"), "a").alias("a"),
        "changed").first()
    assert done.c == want and done.changed == (want != "x")
    assert done.a == ("1" if meta and '"a"' in meta else None)


def test_comment_shape(spark):
    rows = spark.createDataFrame(
        [("c1", "v1", "too short", None), ("c2", "v1", "long enough text " * 100, None),
         ("c3", "v2", "exactly twenty chars", "me")], "cid string, vid string, text string, who string")
    got = {r.post_id: r for r in collector.shape_comments(
        rows, F.col("cid"), F.col("vid"), F.col("who"),
        {"video_id": F.col("vid"), "category": F.lit("employment")},
        F.to_timestamp(F.lit("2024-05-01 10:00:00")), F.when(F.col("who") == "me", 3)).collect()}
    assert set(got) == {"youtube_c2", "youtube_c3"}
    assert len(got["youtube_c2"].text) == 1000 and got["youtube_c2"].author == "Unknown"
    assert got["youtube_c3"].url.endswith("watch?v=v2") and got["youtube_c3"].author == "me"
    assert got["youtube_c3"].platform_metadata == '{"video_id":"v2","category":"employment"}'
    assert [(r.source, r.likes, r.comments_count, r.shares) for r in
            (got["youtube_c2"], got["youtube_c3"])] == [("youtube", 0, 0, 0), ("youtube", 3, 0, 0)]


def test_shaped_comments_enter_the_post_table(spark):
    rows = spark.createDataFrame([(i, "v", f"a comment with words {i % 3}", "me") for i in range(9)],
                                 "cid int, vid string, text string, who string")
    shaped = collector.shape_comments(
        rows, F.col("cid").cast("string"), F.col("vid"), F.col("who"), {"video_id": F.col("vid")},
        F.to_timestamp(F.lit("2024-05-01 10:00:00")), F.lit(1)).withColumn("n", F.col("post_id"))
    path = tables.create_tables(spark, shared_dir(spark, "shaped"))["raw_posts"]
    added = posts.append_posts(spark, shaped, path, "n").collect()
    assert len(added) == 9 and {r.source for r in added} == {"youtube"}
    assert {r.created_date.day for r in added} == {1} and {r.likes for r in added} == {1}
    assert posts.append_posts(spark, shaped, path, "n").count() == 0


def test_ingest_is_counted_in_one_scan(spark):
    rows = spark.createDataFrame([(1, "a", "k"), (2, "b", "k"), (3, "a", "k"), (4, "b", "m"), (5, "b", "m"),
                                  (6, None, "m"), (7, "a", None), (8, "a", None)],
                                 "id int, source string, key string")
    counted = posts.count_ingest(rows, F.col("key"), "id", "source")
    got = {r.source: (r.received, r.inserted, r.duplicates) for r in counted.collect()}
    assert got == {"a": (4, 3, 1), "b": (3, 1, 2), None: (1, 0, 1)}
    kept = posts.first_per_key(rows, F.col("key"), "id")
    again = posts.ingest_counts(rows.fillna("-", ["source"]), kept.fillna("-", ["source"]), ["source"])
    assert {(r.source, r.received, r.inserted) for r in again.collect()} == {
        (s or "-", n, i) for s, (n, i, _) in got.items()}


def test_requests(spark):
    texts = [None, "", "   ", " \t", "x" * 5001, "x" * 5000, "fine"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r.reason for r in quality.validate_requests(rows).orderBy("id").collect()]
    assert got == ["missing", "empty", "blank", "blank", "too long", None, None]
    sizes = spark.createDataFrame([(0,), (1,), (100,), (101,)], "n int")
    assert [r[0] for r in sizes.select(quality.valid_batches(sizes, "n", RequestConfig())).collect()] == [
        False, True, True, False]


def test_checks(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    got = {r.check: (r.value, r.passed) for r in quality.export_checks(rows, 2, ["text"]).collect()}
    assert got == {"row_count": (2, True), "no_null_text": (1, False)}
    assert quality.duplicate_keys(spark.createDataFrame([(1,), (1,), (2,)], "k int"), "k").collect()[0].copies == 2


def test_keywords_are_substrings(spark):
    row = spark.createDataFrame([("Corporate Justice",)], "text string")
    got = keywords.keyword_hits(row, "text").first()
    assert got.Neutral == ["just", "rate"] and got.Positive == []


def test_csv_keeps_every_text(spark):
    rows = spark.createDataFrame(
        [(1, 'say "hi", ok'), (2, "two\nlines"), (3, "NA"), (4, ""), (5, None), (6, " padded "),
         (7, "नौकरी 😀"), (8, "back\\slash"), (9, "a\r\nb"), (10, '"')], "id int, text string")
    path = shared_dir(spark, "csv-test")
    tables.write_csv(rows, path)
    back = tables.read_csv(spark, path, rows.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("meta, want", [
    (None, '{"k":"v"}'), ("{}", '{"k":"v"}'), ('{"a":1,"a":2}', '{"a":1,"a":2,"k":"v"}'),
    ('{"k": "", "a": 1e400}', '{"k":"v", "a": 1e400}'),
    ('{"a": 12345678901234567890123456789012345678901234, "k" : null }',
     '{"a": 12345678901234567890123456789012345678901234, "k" :"v"}'),
    ('{"a": 1.0, "b": {"k": ""}, "c": ["k", {"k": 1}]}',
     '{"a": 1.0, "b": {"k": ""}, "c": ["k", {"k": 1}],"k":"v"}'),
    ('{"x": "k", "k": {"deep": [1, {"k": 2}]}, "y": "a\\"b,}"}', '{"x": "k", "k":"v", "y": "a\\"b,}"}'),
    ('{"k":"","b":2,"k":""}', '{"k":"v","b":2,"k":"v"}'), ("[1]", "[1]"), ("no json", "no json"), ("", "")])
def test_only_the_value_of_the_key_is_replaced(spark, meta, want):
    row = spark.createDataFrame([(meta,)], "m string")
    assert row.select(jsonmeta.set_field(F.col("m"), "k", "v")).first()[0] == want


def test_batch_of_all_pending_posts_is_not_one_task(spark):
    rows = [(i, None if i % 7 else True, f"t{i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, is_processed boolean, text string").repartition(8)
    for limit in (0, 1, 100, 4000, 10_000):
        found = posts.unprocessed(df, limit, ["id"])
        assert "Limit" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert [r.id for r in found.collect()] == [i for i in range(5000) if i % 7][:limit]
