"""Two-level ranks and sums against plain Python on skewed, tied and missing values."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus.config import TfidfConfig
from chorus.operators import ordering, profile, requestlog, split, tfidf


@pytest.fixture(scope="module")
def rows():
    """A third of the rows share one key and one value; some values are missing."""
    rng = random.Random(3)
    out = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", None])
        kind = rng.random()
        value = 7.5 if kind < 0.33 else None if kind < 0.37 else round(rng.uniform(-50, 900), 2)
        out.append((i, key, value))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, k string, v double").repartition(5)


def by_key(rows):
    groups = defaultdict(list)
    for _, k, v in rows:
        if v is not None:
            groups[k].append(v)
    return {k: sorted(v) for k, v in groups.items()}


def test_linear_percentiles(rows, frame):
    counts = ordering.value_counts(frame, ["k"], "v")
    got = ordering.linear_percentiles(counts, ["k"], "v", {"p25": 25, "p50": 50, "p99": 99, "p100": 100})
    for r in got.collect():
        want = np.percentile(by_key(rows)[r.k], [25, 50, 99, 100])
        assert np.allclose([r.p25, r.p50, r.p99, r.p100], want)
        assert r.n == len(by_key(rows)[r.k])


def test_index_percentiles(rows, frame):
    got = requestlog.index_percentiles(frame, ["k"], "v", {"p50": 50, "p95": 95})
    for r in got.collect():
        values = by_key(rows)[r.k]
        n = len(values)
        assert (r.p50, r.p95) == (values[min(n * 50 // 100, n - 1)], values[min(n * 95 // 100, n - 1)])


def test_index_percentile_of_ten(spark):
    ten = spark.createDataFrame([("x", float(i)) for i in range(1, 11)], "k string, v double")
    got = requestlog.index_percentiles(ten, ["k"], "v", {"p50": 50, "p95": 95}).first()
    assert (got.p50, got.p95) == (6.0, 10.0)


def test_median_of_one_group_without_keys(rows, frame):
    counts = ordering.value_counts(frame, [], "v")
    got = ordering.linear_percentiles(counts, [], "v", {"m": 50}).first()
    assert got.m == np.median([v for _, _, v in rows if v is not None])


def test_prefix_sums_and_quota(rows, frame):
    sized = frame.withColumn("w", F.lit(3))
    got = {r.id: r.before_w for r in ordering.prefix_sums(
        sized, ["k"], ["id"], ["w"]).collect()}
    seen = Counter()
    for i, k, _ in rows:
        assert got[i] == 3 * seen[k]
        seen[k] += 1
    kept = ordering.prefix_sums(sized, ["k"], ["id"], ["w"], until={"w": 100})
    assert {r["count"] for r in kept.groupBy("k").count().collect()} == {34}


def test_greedy_quota_keeps_the_crossing_item(spark):
    items = spark.createDataFrame([("k", i, 40) for i in range(4)], "k string, id int, size int")
    kept = ordering.prefix_sums(items, ["k"], ["id"], ["size"], until={"size": 100})
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2]


def test_row_ids(frame):
    got = ordering.dense_row_ids(frame.select("id", "k"), [F.desc("id")]).collect()
    assert sorted(r.row_id for r in got) == list(range(1, 3001))
    assert all(r.row_id == 3000 - r.id for r in got)


def key(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_split_is_exact_and_ignores_partitions(rows, frame, parts):
    got = split.stratified_split(frame.repartition(parts), "id", "k").collect()
    groups = defaultdict(list)
    for i, k, _ in rows:
        groups[k].append(i)
    want = {}
    for ids in groups.values():
        ranked = sorted(ids, key=lambda i: key(42, i))
        for rank, i in enumerate(ranked):
            n = len(ids)
            want[i] = "train" if rank < n * 80 // 100 else "val" if rank < n * 90 // 100 else "test"
    assert {r.id: r.split for r in got} == want


def test_split_of_tiny_classes(spark):
    tiny = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "b")], "id int, k string")
    got = split.stratified_split(tiny, "id", "k").groupBy("k", "split").count().collect()
    assert sum(r["count"] for r in got) == 4


@pytest.mark.parametrize("parts", [1, 8])
def test_sample(rows, frame, parts):
    got = ordering.hashed_sample(frame.repartition(parts), 100, "id", 9).collect()
    want = sorted((i for i, _, _ in rows), key=lambda i: key(9, i))[:100]
    assert sorted(r.id for r in got) == sorted(want)


def test_sample_larger_than_table(spark):
    assert ordering.hashed_sample(spark.range(5), 50, "id", 1).count() == 5


def test_vocabulary_ignores_partitions(spark):
    texts = [(i, " ".join(random.Random(i).choices(["red", "blue", "green", "gray", "pink"], k=6)))
             for i in range(60)]
    config = TfidfConfig(max_features=12)
    views = []
    for parts in (1, 3, 8):
        df = spark.createDataFrame(texts, "id int, t string").repartition(parts)
        rows = tfidf.vocabulary(df, "id", "t", config).orderBy("term").collect()
        views.append([tuple(r) for r in rows])
    assert views[0] == views[1] == views[2] and len(views[0]) == 12


def test_weights_have_unit_length(spark):
    texts = [(0, "alpha beta beta"), (1, "alpha gamma"), (2, "the of and")]
    df = spark.createDataFrame(texts, "id int, t string")
    config = TfidfConfig(min_df=1, max_df=1.0, ngram_max=1)
    vocab = tfidf.vocabulary(df, "id", "t", config)
    long = tfidf.weights(df, "id", "t", vocab, config).collect()
    for i in (0, 1):
        assert abs(sum(r.weight ** 2 for r in long if r.id == i) - 1) < 1e-12
    beta = (1 + np.log(2)) * (np.log(4 / 2) + 1)
    alpha = np.log(4 / 3) + 1
    assert abs(next(r.weight for r in long if r.term == "beta")
               - beta / np.hypot(alpha, beta)) < 1e-12
    vectors = {r.id: r.features for r in tfidf.vectors(df, "id", "t", vocab, 3, config).collect()}
    assert vectors[2].numNonzeros() == 0 and len(vectors[0].indices) == 2


def test_histogram_and_box(rows, frame):
    values = [v for _, _, v in rows if v is not None]
    got = {r.bin: r.n for r in profile.histogram(frame, "v", 50).collect()}
    assert [got[i] for i in range(50)] == list(np.histogram(values, bins=50)[0])
    for r in profile.box_stats(frame, ["k"], "v").collect():
        group = by_key(rows)[r.k]
        q1, q3 = np.percentile(group, [25, 75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert r.whisker_low == min(v for v in group if v >= low)
        assert r.whisker_high == max(v for v in group if v <= high)
        assert r.outliers == sum(v < low or v > high for v in group)


def test_histogram_of_one_value(spark):
    same = spark.createDataFrame([(2.0,)] * 4, "v double")
    assert profile.histogram(same, "v", 5).agg(F.sum("n")).first()[0] == 4


def test_vocabulary_counts_only_ngrams_that_may_enter(spark, monkeypatch):
    import random
    from collections import Counter
    from chorus.config import TfidfConfig
    from chorus.operators import rows, tfidf
    pick = random.Random(5)
    words = [f"z{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    texts = [" ".join(pick.choices(words, weights=range(1, 65), k=pick.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "zak", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    df_of, total = Counter(), Counter()
    for t in texts:
        w = (t or "").split()
        grams = [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
        total.update(grams)
        df_of.update(set(grams))
    for most in (20, 100, 5000):  # cut within the words, after them, not at all
        config = TfidfConfig(max_features=most, min_df=2, max_df=0.9)
        fit = [g for g in total if 2 <= df_of[g] <= 0.9 * len(texts)]
        want = sorted(sorted(fit, key=lambda g: (-total[g], g))[:most])
        found = tfidf.vocabulary(df, "id", "t", config).orderBy("term_id").collect()
        assert [(r.term, r.df, r.total, r.n_docs, r.term_id) for r in found] == [
            (g, df_of[g], total[g], len(texts), i) for i, g in enumerate(want)]
    left = tfidf._frequent_terms(df, "id", "t", TfidfConfig(), tfidf.STOP_WORDS, 50).count()
    assert left == sum(n for g, n in total.items() if " " in g and n >= 50) < sum(total.values()) / 10
    monkeypatch.setattr(rows, "PART_BYTES", 1000)
    size = sum(len(t or "") for t in texts)
    assert rows.place(df, "id", "t").rdd.getNumPartitions() == -(-size // 1000) > 8
