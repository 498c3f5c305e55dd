from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from chorus.llm import whitening


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def kept(rows):
    return [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(np.float32(c)) for c in v)]


def exact_covariance(xs):
    n, d = len(xs), len(xs[0])
    mean = [Fraction(sum(x[j] for x in xs), n) for j in range(d)]
    return np.array([[float(sum((x[a] - mean[a]) * (x[b] - mean[b]) for x in xs) / n)
                      for b in range(d)] for a in range(d)])


def check(got, rows):
    """All columns against plain arithmetic on the distinct vectors."""
    rows = kept(rows)
    xs = sorted({tuple(x) for _, x in rows})
    n, d = len(xs), len(xs[0])
    sums = [sum(x[j] for x in xs) for j in range(d)]
    v = exact_covariance(xs)
    values = np.linalg.eigvalsh(v)[::-1][:16]
    k = min(16, d)
    assert len(got) == len(rows) * k
    deviations = {tuple(x): sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    for i, x in rows:
        mine = by[i]
        assert {r.component for r in mine} == set(range(1, k + 1))
        assert all(r.n == n and r.deviation == deviations[tuple(x)] for r in mine)
        assert all(abs(r.explained - values[r.component - 1] / np.trace(v)) <= 1e-9 for r in mine)
    return by, v, values


def random_rows(n, d, seed, scale=0.2):
    rng = np.random.default_rng(seed)
    mixed = rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) * scale
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]


def test_like_plain_arithmetic_with_a_hot_vector(spark, clashing):
    rows = random_rows(120, 20, 1)
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 19 + [None]), (2003, [float("nan")] + [0.0] * 19),
             (2004, [float("inf")] + [0.0] * 19)]
    got = whitening.whitened(clashing(table(spark, rows))).collect()
    by, v, values = check(got, rows)
    xs = {tuple(x): i for i, x in kept(rows)}
    w = np.array([[r.whitened for r in sorted(by[i], key=lambda r: r.component)[:16]]
                  for i in xs.values()])
    assert np.abs(w.T @ w / len(w) - np.eye(16)).max() < 1e-9
    assert np.abs(w.mean(axis=0)).max() < 1e-9
    assert all(r.identity_error < 1e-9 for r in got)
    # The projection of x - S/n on the component, over sqrt(e): V applied gives the component back.
    y = np.array(list(xs), float) - np.mean(np.array(list(xs), float), axis=0)
    loads = y.T @ w / len(w) / np.sqrt(values)  # e c / sqrt(e) / sqrt(e)
    assert np.abs(v @ loads - loads * values).max() < 1e-6 * values[0]
    assert np.abs(np.linalg.norm(loads, axis=0) - 1).max() < 1e-9


def test_equal_vectors_after_quantising_count_once(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.101, 0.201]), (3, [0.9, -0.3]), (4, [-0.4, 0.7]), (5, [0.1, 0.2])]
    got = whitening.whitened(table(spark, rows)).collect()
    check(got, rows)
    assert {r.n for r in got} == {3}


def test_no_variance(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])]
    got = whitening.whitened(table(spark, rows)).collect()
    assert len(got) == 6
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {
        (1, 0, None, None, None)}


def test_components_without_variance_are_null(spark):
    rows = [(i, [i / 4, i / 2, 1.0]) for i in range(9)]
    got = whitening.whitened(table(spark, rows)).collect()
    first = [r for r in got if r.component == 1]
    assert all(abs(r.explained - 1) < 1e-12 and r.whitened is not None for r in first)
    assert all(r.whitened is None and r.explained == 0 for r in got if r.component > 1)
    assert all(r.identity_error < 1e-12 for r in got)


def test_vectors_are_fitted_with_those_of_their_length(spark):
    two, three = random_rows(30, 2, 2), [(100 + i, v) for i, v in random_rows(40, 3, 3)]
    got = whitening.whitened(table(spark, two + three)).collect()
    check([r for r in got if r.vec_id < 100], two)
    check([r for r in got if r.vec_id >= 100], three)


def test_huge_and_tiny_entries(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]
    got = whitening.whitened(table(spark, rows)).collect()
    assert len(got) == 6
    assert {(r.vec_id, r.deviation) for r in got} == {(1, None), (2, None), (3, (3 * 128 - 192) ** 2)}


def test_empty_table(spark):
    assert whitening.whitened(table(spark, [])).collect() == []
    assert whitening.whitened(table(spark, [(1, None)])).collect() == []


@pytest.mark.parametrize("most", [40, 1 << 40])
def test_square_sums_are_exact(most):
    rng = np.random.default_rng(0)
    z = rng.integers(-most, most, (300, 5))
    rows = [[int(a) for a in r] for r in z]
    want = [sum((r[i] + (r[j] if j != i else 0)) ** 2 for r in rows)
            for i in range(5) for j in range(i, 5)]
    assert whitening.square_sums(z) == want


def test_covariances_by_polarisation():
    rng = np.random.default_rng(4)
    xs = [[int(a) for a in r] for r in rng.integers(999_900, 1_000_100, (60, 4))]
    n, sums = len(xs), [sum(x[j] for x in xs) for j in range(4)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    flat = whitening.square_sums(np.array(xs) - np.array(centre))
    squares = dict(zip([(i, j) for i in range(4) for j in range(i, 4)], flat))
    got = whitening.covariance(n, centre, sums, squares)
    assert np.array_equal(got, exact_covariance(xs))


def test_query_over_the_whole_table(spark, data):
    from chorus.llm import catalog
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet")
            .select("vec_id", "embedding").collect()]
    got = catalog.QUERIES["op13_whitening"](spark, data).collect()
    xs = [x for _, x in kept(rows)]
    v = np.cov(np.array(sorted(set(map(tuple, xs))), float).T, bias=True)
    values = np.linalg.eigvalsh(v)[::-1]
    assert len(got) == 16 * len(xs)
    assert all(abs(r.explained * np.trace(v) / values[r.component - 1] - 1) < 1e-6 for r in got)
    assert got[0].identity_error < 1e-9
