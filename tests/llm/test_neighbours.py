from __future__ import annotations

import numpy as np

from chorus.llm import neighbours


def brute(ids, vectors, k=10, every=100):
    out = {}
    for i, v in zip(ids, vectors):
        if i % every == 0:
            d = np.sqrt(((vectors - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = r
    hits = sum(len({r.vec_id for r in found[q].values()} & {i for i, _ in near})
               for q, near in want.items())
    for q, ranks in found.items():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))
        pairs = [(ranks[i].score, ranks[i].vec_id) for i in sorted(ranks)]
        assert pairs == sorted(pairs)
    return hits / sum(map(len, want.values()))


def test_recall_on_given_vectors(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = table.collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.array([r.embedding for r in rows], float)
    got = neighbours.nearest_neighbours(table).collect()
    want = brute(ids, vectors)
    assert {r.query_id for r in got} == set(want)
    assert recall(got, want) >= 0.9
    exact = {(q, i): d for q, near in want.items() for i, d in near}
    assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got
               if (r.query_id, r.vec_id) in exact)


def test_recall_on_clusters_and_ties(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 24))
    vectors = centres[rng.integers(0, 30, 4000)] + 0.1 * rng.standard_normal((4000, 24))
    vectors[500:900] = vectors[500]  # a large group of equal vectors
    ids = np.arange(4000)
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, vectors)],
                               "vec_id long, embedding array<double>, score string").repartition(7)
    got = neighbours.nearest_neighbours(df).collect()
    want = brute(ids, vectors)
    assert recall(got, want) >= 0.9
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 600), key=lambda r: r.rank)] \
        == list(range(500, 510))


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 0.5]), (100, [1.0, 0.0]),
            (8, [1.0, 0.0, 0.0]), (200, [0.0, 0.0]), (9, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r)[:4] for r in neighbours.nearest_neighbours(df).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 1, 1.0), (0, 3, 9, 1.0),
                   (100, 1, 0, 0.0), (100, 2, 1, 1.0), (100, 3, 9, 1.0)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    got = neighbours.nearest_neighbours(df)
    assert got.count() == 0 and got.columns == [
        "query_id", "rank", "vec_id", "score", "query_key"]


def test_query_ids_with_several_vectors(spark):
    """Each different vector of an id is a query; equal rows are one query, two candidates."""
    rows = [(100, [1.0, 0.0]), (100, [0.0, 5.0]), (100, [1.0, 0.0]), (1, [2.0, 0.0]),
            (1, [2.0, 0.0]), (2, [0.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = neighbours.nearest_neighbours(df).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r.rank):
        lists.setdefault((r.query_id, r.query_key), []).append((r.rank, r.vec_id, r.score))
    assert len(lists) == 2
    assert sorted(lists.values()) == [
        [(1, 1, 1.0), (2, 1, 1.0), (3, 2, 17 ** 0.5)],
        [(1, 2, 1.0), (2, 1, 29 ** 0.5), (3, 1, 29 ** 0.5)]]


def test_more_blocks_and_shards_than_one(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 10)
    monkeypatch.setattr(neighbours, "SHARD", 100)
    rng = np.random.default_rng(6)
    ids, vectors = np.arange(1500), rng.standard_normal((1500, 8))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)],
                               "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(df, every=20).collect()
    assert len(got) == 750
    assert recall(got, brute(ids, vectors, every=20)) >= 0.9
