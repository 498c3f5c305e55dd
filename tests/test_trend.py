"""The local regression against one on the rows themselves."""

from __future__ import annotations

import numpy as np

from chorus.operators import trend


def brute(x, y, at, span):
    """A line through the nearest rows, weighted by the tricube of their distance."""
    d = np.abs(x - at)
    h = np.sort(d)[int(np.ceil(span * len(x))) - 1] * 1.0000001
    w = np.where(d < h, (1 - np.minimum(d / h, 1) ** 3) ** 3, 0)
    mx, my = np.average(x, weights=w), np.average(y, weights=w)
    spread = np.average((x - mx) ** 2, weights=w)
    slope = np.average((x - mx) * (y - my), weights=w) / spread if spread > 1e-12 else 0
    return my + slope * (at - mx)


def test_like_a_regression_on_the_rows(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.uniform(0, 10, 3000), rng.normal(3, 0.2, 1500)])
    y = np.sin(x) + rng.normal(0, 0.1, len(x))
    rows = [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, float("nan")), (float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(4)
    got = trend.local_trend(df, "x", "y", points=15, span=0.3).orderBy("point").collect()
    assert len(got) == 15
    for r in got:
        assert abs(r.fitted - brute(x, y, r.at, 0.3)) < 5e-3


def test_a_line_is_found_exactly(spark):
    df = spark.createDataFrame([(float(i), 3.0 * i - 7) for i in range(500)], "x double, y double")
    for r in trend.local_trend(df, "x", "y", points=6).collect():
        assert abs(r.fitted - (3 * r.at - 7)) < 1e-6


def test_one_value_and_no_rows(spark):
    df = spark.createDataFrame([(2.0, float(i)) for i in range(5)], "x double, y double")
    got = trend.local_trend(df, "x", "y", points=3).collect()
    assert {(r.at, r.fitted) for r in got} == {(2.0, 2.0)}
    assert trend.local_trend(df.limit(0), "x", "y").collect() == []
