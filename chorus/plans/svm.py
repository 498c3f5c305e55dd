"""Linear support vector machine with squared hinge loss, one per class, all in one solver.

For every class the objective is

    |w|^2 / 2 + C sum of max(0, 1 - y w.x)^2

with y = 1 for the class and -1 for the rest, and a constant feature for the intercept,
which is regularised like the others. A trust-region Newton method solves it: the inner
conjugate gradients only need products of the generalised Hessian with a direction,
``v + 2 C X'(I (X v))`` over the rows inside the margin, which are sums over blocks of
rows. All classes move together, so a pass over the blocks serves every class; a class
that has converged takes no more part. Sums are combined in a tree of tasks; what reaches
the driver has the size of the model.

A class ends when the norm of its gradient is at most ``tol`` times the smaller share of
the two sides times the norm at zero, the usual rule of this solver. The model carries the
norms it ended with.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import DenseMatrix, VectorUDT
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import (DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable,
                             MLWriter)
from pyspark.sql import DataFrame, functions as F, types as T

from chorus.config import SvmConfig
from chorus.plans import blocks

_ETA = (1e-4, 0.25, 0.75)  # of the trust region
_SIGMA = (0.25, 0.5, 4.0)
_FLAT = 32  # sums of so many tasks are added without tasks of their own
_WEIGHTS = "class int, feature int, weight double"


def margins(block: blocks.Block, w: np.ndarray) -> np.ndarray:
    """Rows x classes: the scores under weights of shape (features + 1) x classes."""
    found = np.empty((len(block.labels), w.shape[1]))
    filled = np.flatnonzero(np.diff(block.indptr))
    for k in range(w.shape[1]):
        column = np.zeros(len(block.labels))
        if len(filled):
            column[filled] = np.add.reduceat(block.values * w[block.indices, k], block.indptr[filled])
        found[:, k] = column + w[-1, k]
    return found


def transposed(block: blocks.Block, rows: np.ndarray, size: int) -> np.ndarray:
    """(features + 1) x classes: the sum of the rows, each times its value per class."""
    of_entry = block.row_of_entry()
    found = np.empty((size + 1, rows.shape[1]))
    for k in range(rows.shape[1]):
        found[:-1, k] = np.bincount(block.indices, block.values * rows[of_entry, k], size)
    found[-1] = rows.sum(axis=0)
    return found


def _signs(block: blocks.Block, classes: Sequence[int]) -> np.ndarray:
    return np.where(block.labels[:, None] == np.asarray(classes), 1.0, -1.0)


def loss_and_gradient(block: blocks.Block, w: np.ndarray, classes: Sequence[int], c: float, size: int):
    """Loss per class and its gradient over one block, without the regularisation."""
    short = 1 - _signs(block, classes) * margins(block, w)
    short = np.maximum(short, 0.0)
    return c * (short * short).sum(axis=0), transposed(block, -2 * c * _signs(block, classes) * short, size)


def hessian_product(block: blocks.Block, w: np.ndarray, v: np.ndarray, classes: Sequence[int],
                    c: float, size: int) -> np.ndarray:
    """The product of the loss's generalised Hessian at w with v over one block."""
    inside = _signs(block, classes) * margins(block, w) < 1
    return transposed(block, 2 * c * inside * margins(block, v), size)


class _Sums:
    """Sums over the blocks of a training table."""

    def __init__(self, cells, size: int, c: float):
        self.cells, self.size, self.c, self.passes = cells, size, c, 0

    def _add(self, fn):
        self.passes += 1
        depth = 1 if self.cells.getNumPartitions() <= _FLAT else 2
        return self.cells.map(fn).treeReduce(lambda a, b: tuple(x + y for x, y in zip(a, b)), depth)

    def value(self, w: np.ndarray, classes: list[int]):
        """Objective and gradient of the given classes."""
        size, c = self.size, self.c
        loss, gradient = self._add(lambda b: loss_and_gradient(b, w, classes, c, size))
        return (w * w).sum(axis=0) / 2 + loss, w + gradient

    def product(self, w: np.ndarray, v: np.ndarray, classes: list[int]) -> np.ndarray:
        size, c = self.size, self.c
        return v + self._add(lambda b: (hessian_product(b, w, v, classes, c, size),))[0]


def _steps(sums: _Sums, w: np.ndarray, gradient: np.ndarray, radius: np.ndarray, classes: list[int],
           least: float = 0.1):
    """Truncated conjugate gradients of all classes; returns steps and their residuals.

    A class leaves the loop at the border of its region or when its residual has fallen to
    ``least`` of the gradient.
    """
    k = len(classes)
    s, r = np.zeros_like(w), -gradient
    d = r.copy()
    limit = least * np.linalg.norm(gradient, axis=0)
    rr = (r * r).sum(axis=0)
    going = np.flatnonzero(np.sqrt(rr) > limit)
    while len(going):
        hd = sums.product(w[:, going], d[:, going], [classes[i] for i in going])
        alpha = rr[going] / (d[:, going] * hd).sum(axis=0)
        held = s[:, going] + alpha * d[:, going]
        still = []
        for at, i in enumerate(going):
            if np.linalg.norm(held[:, at]) >= radius[i]:
                sd, dd, ss = s[:, i] @ d[:, i], d[:, i] @ d[:, i], s[:, i] @ s[:, i]
                root = np.sqrt(sd * sd + dd * (radius[i] ** 2 - ss))
                a = (radius[i] ** 2 - ss) / (sd + root) if sd >= 0 else (root - sd) / dd
                s[:, i] += a * d[:, i]
                r[:, i] -= a * hd[:, at]
                continue
            s[:, i] = held[:, at]
            r[:, i] -= alpha[at] * hd[:, at]
            new = r[:, i] @ r[:, i]
            d[:, i] = r[:, i] + new / rr[i] * d[:, i]
            rr[i] = new
            if np.sqrt(new) > limit[i]:
                still.append(i)
        going = np.array(still, int)
        if sums.passes > 100 * k + 10_000:
            raise RuntimeError("conjugate gradients do not end")
    return s, r


def solve(sums: _Sums, classes: list[int], shares: np.ndarray, tol: float, max_iter: int):
    """Weights (features + 1) x classes, gradient norms and the norms they had to reach."""
    w = np.zeros((sums.size + 1, len(classes)))
    value, gradient = sums.value(w, classes)
    norm = np.linalg.norm(gradient, axis=0)
    goal = tol * np.maximum(shares, 1e-12) * norm
    radius = norm.copy()
    first = True
    for _ in range(max_iter):
        open_ = np.flatnonzero(np.linalg.norm(gradient, axis=0) > goal)
        if not len(open_):
            break
        names = [classes[i] for i in open_]
        s, r = _steps(sums, w[:, open_], gradient[:, open_], radius[open_], names)
        new = w[:, open_] + s
        new_value, new_gradient = sums.value(new, names)
        gs = (gradient[:, open_] * s).sum(axis=0)
        expected = -0.5 * (gs - (s * r).sum(axis=0))
        gained = value[open_] - new_value
        length = np.linalg.norm(s, axis=0)
        if first:
            radius[open_] = np.minimum(radius[open_], length)
            first = False
        for at, i in enumerate(open_):
            bend = new_value[at] - value[i] - gs[at]
            alpha = _SIGMA[2] if bend <= 0 else max(_SIGMA[0], -0.5 * gs[at] / bend)
            low, high = _SIGMA[0], _SIGMA[1]
            if gained[at] < _ETA[0] * expected[at]:
                radius[i] = min(max(alpha, low) * length[at], high * radius[i])
            elif gained[at] < _ETA[1] * expected[at]:
                radius[i] = max(low * radius[i], min(alpha * length[at], high * radius[i]))
            elif gained[at] < _ETA[2] * expected[at]:
                radius[i] = max(low * radius[i], min(alpha * length[at], _SIGMA[2] * radius[i]))
            else:
                radius[i] = max(radius[i], min(alpha * length[at], _SIGMA[2] * radius[i]))
            if gained[at] > _ETA[0] * expected[at]:
                w[:, i], value[i], gradient[:, i] = new[:, at], new_value[at], new_gradient[:, at]
            elif abs(gained[at]) <= 1e-15 * abs(value[i]):
                goal[i] = np.inf  # the objective no longer changes in double precision
    return w, np.linalg.norm(gradient, axis=0), tol * np.maximum(shares, 1e-12) * norm


class SquaredHingeModel(Model, HasFeaturesCol, MLWritable, MLReadable):
    """Weights per class; adds ``rawPrediction`` (the margins) and ``prediction``."""

    def __init__(self, weights: np.ndarray | None = None, norms: Sequence[float] = (),
                 goals: Sequence[float] = ()):
        super().__init__()
        self.weights = np.zeros((1, 0)) if weights is None else weights
        self.norms, self.goals = list(norms), list(goals)

    @property
    def numClasses(self) -> int:
        return self.weights.shape[1]

    @property
    def coefficientMatrix(self) -> DenseMatrix:
        """Classes x features, as the models of Spark ML give it."""
        return DenseMatrix(self.numClasses, len(self.weights) - 1, self.weights[:-1].ravel())

    @property
    def interceptVector(self) -> list[float]:
        return [float(x) for x in self.weights[-1]]

    def table(self, spark) -> DataFrame:
        """The weights that are not zero; the intercept is the feature after the last."""
        rows = [(int(k), int(f), float(self.weights[f, k])) for f, k in zip(*np.nonzero(self.weights))]
        return spark.createDataFrame(rows, _WEIGHTS)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features, names = self.getFeaturesCol(), dataset.columns
        sent = dataset.sparkSession.sparkContext.broadcast(self.weights)

        def score(batches: Iterator[pa.RecordBatch]):
            w = sent.value
            for b in batches:
                counts, indices, values, _ = blocks.entries(blocks.as_struct(b.column(features)))
                known = indices < len(w) - 1
                if not known.all():
                    row = np.repeat(np.arange(len(counts)), counts)[known]
                    counts, indices, values = (np.bincount(row, minlength=len(counts)),
                                               indices[known], values[known])
                indptr = np.concatenate([[0], np.cumsum(counts)])
                m = margins(blocks.Block(indptr, indices, values, np.zeros(len(counts)), len(w) - 1), w)
                n, k = m.shape
                vector = pa.StructArray.from_arrays(
                    [pa.array([1] * n, pa.int8()), pa.nulls(n, pa.int32()),
                     pa.nulls(n, pa.list_(pa.int32())),
                     pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), m.ravel())],
                    names=["type", "size", "indices", "values"])
                best = pa.array(m.argmax(axis=1).astype(float)) if k else pa.nulls(n, pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns, vector, best],
                                                 names=[*names, "rawPrediction", "prediction"])

        out = T.StructType([*dataset.schema.fields, T.StructField("rawPrediction", VectorUDT()),
                            T.StructField("prediction", T.DoubleType())])
        return dataset.mapInArrow(score, out)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: SquaredHingeModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={
            "shape": list(m.weights.shape), "norms": [float(x) for x in m.norms],
            "goals": [float(x) for x in m.goals]})
        m.table(self.sparkSession).coalesce(1).write.parquet(f"{path}/weights")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SquaredHingeModel:
        known = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        w = np.zeros(known["shape"])
        for r in self.sparkSession.read.schema(_WEIGHTS).parquet(f"{path}/weights").collect():
            w[r["feature"], r["class"]] = r["weight"]
        model = self.cls(w, known["norms"], known["goals"])
        model._resetUid(known["uid"])
        DefaultParamsReader.getAndSetParams(model, known)
        return model


class SquaredHingeSvm(Estimator, HasFeaturesCol, HasLabelCol):
    """Trains :class:`SquaredHingeModel`; labels are 0 to classes - 1."""

    def __init__(self, classes: int, id_col: str, config: SvmConfig = SvmConfig()):
        super().__init__()
        self.classes, self.id_col, self.config = classes, id_col, config

    def _fit(self, dataset: DataFrame) -> SquaredHingeModel:
        spark, features, label = dataset.sparkSession, self.getFeaturesCol(), self.getLabelCol()
        rows = dataset.select(self.id_col, label, F.col(features).alias("features"))
        n, nnz = blocks.table_size(rows)
        if not n:
            raise ValueError("training needs rows")
        parts = max(spark.sparkContext.defaultParallelism, -(-nnz // blocks.ENTRIES))
        staged = blocks.row_blocks(rows, self.id_col, label, parts)
        size = staged.agg(F.max("size")).first()[0]
        by_class = {int(r[0]): r[1] for r in rows.groupBy(label).count().collect()}
        counts = np.array([by_class.get(k, 0) for k in range(self.classes)], float)
        cells = (staged.rdd.map(lambda r: (r["part"], blocks.block(r)))
                 .partitionBy(parts, lambda part: part).values().persist(StorageLevel.MEMORY_AND_DISK))
        try:
            w, norms, goals = solve(_Sums(cells, size, self.config.c), list(range(self.classes)),
                                    np.minimum(counts, n - counts) / n, self.config.tol,
                                    self.config.max_iter)
        finally:
            cells.unpersist()
        return SquaredHingeModel(w, norms, goals)._set(featuresCol=features)
