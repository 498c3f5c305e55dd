"""Whitening of embeddings from polarised exact variances (operator 13).

Vectors are quantised to long integers. The fit list holds every distinct vector once.
One pass gives its size n and the sums S; a second centres every vector on the integers
nearest to the means and adds up squares: those of every dimension and those of the sum
of every pair of dimensions. All sums are exact integers. By polarisation

    2 n^2 cov(i, j) = n^2 var(i + j) - n^2 var(i) - n^2 var(j)

with n^2 var(u) = n sum(u^2) - (sum u)^2, which does not depend on the integer shift, so
every covariance is an exact fraction and is rounded once, to a double. The matrix, whose
size is the square of the dimension, goes to the driver for the eigenvectors; rows never
do. Tasks add up a vector of sums each, the sums of tasks are added by Spark.

A last pass over the fit list measures the covariance of the whitened vectors.

Defined results: rows whose vector is null, empty, or holds a null or a non-finite entry
are dropped, all others are returned, repeated rows too, also with a missing id. Vectors
are fitted with those of their own length. An entry beyond ``BOUND / 64`` counts as that
bound. A component without variance (an eigenvalue that is zero in double precision) has
a null ``whitened``, and ``explained`` is null where nothing varies; both stay out of
``identity_error``, which is then null. A ``deviation`` beyond a long is null. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chorus.llm.common import stage

SCALE = 64
SHIFT = 1_000_000
#: Largest magnitude of a scaled entry; its squares summed over 10^9 rows fit 38 digits.
BOUND = float(1 << 46)
COMPONENTS = 16
_LONG = (1 << 63) - 1
_SUMS = "i int, j int, total decimal(38,0)"
_DIGITS = pa.decimal128(38, 0)


def usable(vector: Column) -> Column:
    """No null vector, no empty one, no null or non-finite entry."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def quantised(vector: Column) -> Column:
    """``floor(64 c) + 1000000`` of every entry, as longs."""
    def one(c: Column) -> Column:
        scaled = F.greatest(F.least(c * SCALE, F.lit(BOUND)), F.lit(-BOUND))
        return F.floor(scaled) + F.lit(SHIFT).cast("long")

    return F.transform(vector, one)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _totals(keys: list[tuple[int, int]], sums: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "i": pa.array([k[0] for k in keys], pa.int32()), "j": pa.array([k[1] for k in keys], pa.int32()),
        "total": pa.array([Decimal(s) for s in sums], _DIGITS)})


def _added(parts: DataFrame) -> dict[tuple[int, int], int]:
    """The sums of all tasks; as many rows as there are dimensions and pairs."""
    rows = parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    return {(r["i"], r["j"]): int(r["total"]) for r in rows}


def _sums(batches: Iterator[pa.RecordBatch]):
    """Row count (at -1) and exact sums per dimension of one task."""
    n, sums = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            n += len(x)
            part = [int(s) for s in x.sum(axis=0)]  # below 2^47 rows of a batch below 2^16
            sums = part if sums is None else [a + b for a, b in zip(sums, part)]
    if n:
        yield _totals([(-1, -1), *((i, i) for i in range(len(sums)))], [n, *sums])


def square_sums(z: np.ndarray) -> list[int]:
    """Exact sums of squares of each column and of the sum of each pair of columns.

    In the order (0,0), (0,1), ... (1,1), ...; a pair (i, i) is column i alone.
    """
    most = int(np.abs(z).max(initial=0))
    if len(z) * (2 * most) ** 2 > _LONG:  # beyond a long: Python integers
        z = z.astype(object)
    found: list[int] = []
    for i in range(z.shape[1]):
        found.append(int((z[:, i] * z[:, i]).sum()))
        pairs = z[:, i, None] + z[:, i + 1:]
        found += [int(s) for s in (pairs * pairs).sum(axis=0)]
    return found


def _squares(centre: list[int]):
    def run(batches: Iterator[pa.RecordBatch]):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = square_sums(_matrix(batch.column(0)) - np.array(centre, np.int64))
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            d = len(centre)
            yield _totals([(i, j) for i in range(d) for j in range(i, d)], total)

    return run


@dataclass(frozen=True)
class Whitening:
    """Size and sums of the fit list and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray  # dimension x components
    values: np.ndarray  # eigenvalues, zero where nothing varies
    trace: float

    def scale(self) -> np.ndarray:
        """What maps a centred vector to its whitened coordinates; NaN without variance."""
        with np.errstate(divide="ignore"):
            return self.components * np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)


def covariance(n: int, centre: list[int], sums: list[int],
               squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix from the exact square sums, each entry rounded once."""
    d = len(sums)
    rest = [s - n * c for s, c in zip(sums, centre)]  # sums of the centred columns
    alone = [n * squares[i, i] - rest[i] ** 2 for i in range(d)]
    v = np.zeros((d, d))
    for i in range(d):
        v[i, i] = float(Fraction(alone[i], n * n))
        for j in range(i + 1, d):
            both = n * squares[i, j] - (rest[i] + rest[j]) ** 2
            v[i, j] = v[j, i] = float(Fraction(both - alone[i] - alone[j], 2 * n * n))
    return v


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on the column ``x`` of distinct vectors of one length."""
    only = distinct.select("x")
    first = _added(only.mapInArrow(_sums, _SUMS))
    n = first.pop((-1, -1))
    sums = [first[i, i] for i in range(len(first))]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    squares = _added(only.mapInArrow(_squares(centre), _SUMS))
    v = covariance(n, centre, sums, squares)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components].copy(), vectors[:, ::-1][:, :components]
    trace = float(np.trace(v))
    values[values <= len(v) * np.finfo(float).eps * max(trace, 0.0)] = 0.0
    return Whitening(n, sums, np.ascontiguousarray(vectors), values, trace)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S/n`` in doubles: whole parts are taken off in integers first."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([float(Fraction(s % n, n)) for s in sums])
    return (x - whole).astype(np.float64) - part


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)^2; None beyond a long."""
    whole, rest = [s // n for s in sums], [s % n for s in sums]
    z = x - np.array(whole, np.int64)
    most = n * (int(np.abs(z).max(initial=0)) + 1)
    kind = np.int64 if x.shape[1] * most * most <= _LONG else object
    y = z.astype(kind) * n - np.array(rest, kind)
    return [int(t) if t <= _LONG else None for t in (y * y).sum(axis=1)]


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the measured covariance of the whitened fit list, less identity."""
    there = np.flatnonzero(model.values > 0)
    if not len(there):
        return None
    n, sums, scale, k = model.n, model.sums, model.scale()[:, there], len(there)

    def run(batches: Iterator[pa.RecordBatch]):
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = _centred(_matrix(batch.column(0)), n, sums) @ scale
                total += w.sum(axis=0)
                products += w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array([*i, *range(k)], pa.int32()), "j": pa.array([*j, *[-1] * k], pa.int32()),
            "total": pa.array([*products.ravel(), *total], pa.float64())})

    rows = (distinct.select("x").mapInArrow(run, "i int, j int, total double")
            .groupBy("i", "j").agg(F.sum("total").alias("total")).collect())
    got = {(r["i"], r["j"]): r["total"] / n for r in rows}
    return max(abs(got[i, j] - got[i, -1] * got[j, -1] - (i == j))
               for i in range(k) for j in range(k))


def project(rows: DataFrame, model: Whitening, error: float | None) -> DataFrame:
    """One row per vector (id, x) and component."""
    n, sums, scale = model.n, model.sums, model.scale()
    k = scale.shape[1]
    share = [float(e) / model.trace if model.trace > 0 else None for e in model.values]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            x, rows = _matrix(batch.column(1)), batch.num_rows
            w = (_centred(x, n, sums) @ scale).ravel()
            every = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0).take(pa.array(every)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                "n": pa.array(np.full(rows * k, n, np.int64)),
                "deviation": pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(every)),
                "whitened": pa.array(w, pa.float64(), mask=np.isnan(w)),
                "explained": pa.array(share * rows, pa.float64()),
                "identity_error": pa.array([error] * (rows * k), pa.float64())})

    return rows.mapInArrow(run, "id long, component int, n long, deviation long, whitened double, "
                                "explained double, identity_error double")


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
             vector_col: str = "embedding") -> DataFrame:
    """The first components of every vector, whitened by the covariance of all."""
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"),
                           F.col(vector_col).cast("array<double>").alias("vector"))
            .filter(usable(F.col("vector"))).select("id", quantised(F.col("vector")).alias("x")))
    distinct = stage(rows.select("x").distinct(), "whitening-fit")
    found = None
    for (length,) in distinct.select(F.size("x")).distinct().collect():
        own = distinct.filter(F.size("x") == length)
        model = fit(own, components)
        part = project(rows.filter(F.size("x") == length), model, identity_error(own, model))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame(
            [], f"{id_col} long, component int, n long, deviation long, whitened double, "
                "explained double, identity_error double")
    return found.withColumnRenamed("id", id_col)
