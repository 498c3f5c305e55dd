"""Softmax gradient boosting on sparse, non-negative features.

Every round fits one regression tree per class to the shared residuals (indicator of the
class less its softmax probability) and adds its Newton leaf values times the step. Trees
grow level by level over histograms of quantile bins (:mod:`chorus.plans.columns`). All
nodes of a level of all classes are one Spark job, or two where there are many rows.

A task holds a range of the features for all rows. It needs no other task for its best
boundaries, so no histogram is shuffled; the driver gets one candidate per node and range.
What goes to all tasks is one bit per row, class and level. Scores and nodes of the rows follow
from these bits. A Python worker keeps them between jobs (:class:`Rows`) and adds what is new; a
new worker, also one of a lost executor, makes them from the bits of all rounds. So only columns
are persisted, and once. Every ``REPLAY`` rounds their bits become one broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import (DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable,
                             MLWriter)
from pyspark.sql import DataFrame, SparkSession, types as T

from chorus.config import BoostConfig
from chorus.plans import blocks, columns
from chorus.plans.columns import Bins, Columns, Dealt, Level

REPLAY = 10
#: Bytes of row bits that candidates may bring along; beyond it only chosen ones are asked for.
EAGER = 8_000_000
#: Entries, and sums of bins and nodes, that a task works on at once.
AT_ONCE = 1 << 18
LEAST_GAIN = 1e-12
#: Gains that differ by this share are alike: sums of like columns are rounded otherwise where they lie.
TIE = 1e-9
_TREES = ("round int, class int, node int, feature int, edge double, bin long, left int, "
          "right int, value double, gain double, rows long")


@dataclass
class Tree:
    """Nodes in the order of their making; a leaf has no feature (-1)."""

    feature: list[int] = field(default_factory=lambda: [-1])
    edge: list[float] = field(default_factory=lambda: [0.0])
    bin: list[int] = field(default_factory=lambda: [-1])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, edge: float, bin: int, gain: float) -> tuple[int, int]:
        self.feature[node], self.edge[node], self.bin[node] = feature, edge, bin
        self.gain[node] = gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for values, empty in ((self.feature, -1), (self.edge, 0.0), (self.bin, -1), (self.left, -1),
                              (self.right, -1), (self.value, 0.0), (self.gain, 0.0), (self.rows, 0)):
            values.extend([empty, empty])
        return self.left[node], self.right[node]


class Sent(NamedTuple):
    """What tasks need to know of the fit so far."""

    fit: str  # no other fit has this name
    start: np.ndarray
    step: float
    rounds: list  # broadcast lists of (leaf values per class, levels), and how many rounds each has
    levels: tuple  # of the round that is grown


class Rows:
    """Scores of all rows after some rounds, and their nodes in the trees of the next one."""

    def __init__(self, sent: Sent, n: int):
        self.fit, self.step = sent.fit, sent.step
        self.scores = np.tile(sent.start, (n, 1))
        self.begin(0)

    def begin(self, rounds: int) -> None:
        n, classes = self.scores.shape
        self.rounds, self.levels, self.p = rounds, 0, None
        self.at = [np.zeros(n, np.int32) for _ in range(classes)]

    def descend(self, levels) -> None:
        """Move the rows down by the levels that are new to them."""
        for level in levels[self.levels:]:
            self.at = [one.descend(at) for one, at in zip(level, self.at)]
        self.levels = len(levels)

    def add(self, values: list[np.ndarray], levels) -> None:
        """Add a round that is grown."""
        self.descend(levels)
        for k, leaf in enumerate(values):
            self.scores[:, k] += self.step * leaf[self.at[k]]
        self.begin(self.rounds + 1)

    def probabilities(self) -> np.ndarray:
        if self.p is None:
            self.p = softmax(self.scores)
        return self.p


#: The rows that this Python worker knows: those of the fit it worked on last.
_KNOWN: list[Rows] = []


def rows_now(sent: Sent, n: int) -> Rows:
    """The rows after all that was sent, from those the worker knows, or from the start."""
    many, held = sum(m for _, m in sent.rounds), _KNOWN.pop() if _KNOWN else None
    if held is None or held.fit != sent.fit or (held.rounds, held.levels) > (many, len(sent.levels)):
        held = Rows(sent, n)
    first = 0
    for some, m in sent.rounds:
        if held.rounds < first + m:
            for values, levels in some.value[held.rounds - first:]:
                held.add(values, levels)
        first += m
    held.descend(sent.levels)
    _KNOWN[:] = [held]  # only whole ones are kept
    return held


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


class Split(NamedTuple):
    gain: float
    bin: int
    left: tuple[float, float, float]  # count, residuals, curvatures
    right: tuple[float, float, float]


class Opened(NamedTuple):
    """The open nodes of the tree of a class, and what their rows add to the sums."""

    k: int
    nodes: list[int]
    slot: np.ndarray  # of the rows: the place of their node among the open ones, or the last
    residual: np.ndarray
    curvature: np.ndarray
    totals: np.ndarray  # counts, residuals and curvatures of the nodes
    best: np.ndarray  # gains of the best boundaries so far
    bins: np.ndarray  # of them, counted from the first of the range


def opened(held: Columns, rows: Rows, active: list[list[int]], room: int) -> Iterator[Opened]:
    """The classes with open nodes, with ``room`` places for nodes."""
    p = rows.probabilities()
    for k, nodes in enumerate(active):
        if nodes:
            m, at = len(nodes), rows.at[k]
            slots = np.full(max(int(at.max()), max(nodes)) + 1, room - 1, np.min_scalar_type(room))
            slots[nodes] = np.arange(m)
            slot, residual, curvature = slots[at], (held.labels == k) - p[:, k], p[:, k] * (1 - p[:, k])
            totals = np.stack([np.bincount(slot, w, m)[:m].astype(float)
                               for w in (None, residual, curvature)])
            yield Opened(k, nodes, slot, residual, curvature, totals, np.full(m, LEAST_GAIN), np.full(m, -1))


def best_boundaries(held: Columns, rows: Rows, active: list[list[int]], bins: Bins,
                    least_rows: int) -> list[Opened]:
    """The best boundaries of all open nodes in the range, some features after the others.

    Ties go to the lower bin, also those that differ by the rounding of their sums.

    What is summed and looked through at once, and the slots and residuals of the rows of one
    class, mostly stay in the caches of a core.
    """
    root = rows.levels == 0
    room = 1 if root else max(map(len, active)) + 1
    first = bins.first[held.low:held.high + 1] - bins.first[held.low]
    ends = held.starts[1:] + room * first[1:]
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(AT_ONCE, ends[-1], AT_ONCE), "right"), len(ends)])
    found, in_root = [], {}
    for one in opened(held, rows, active, room):
        found.append(one)
        m = len(one.nodes)
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            a, b = held.starts[low], held.starts[high]
            if a == b:
                continue
            of, entry = first[low:high + 1] - first[low], held.rows[a:b].astype(np.intp)
            key = np.repeat(of[:-1].astype(np.intp), np.diff(held.starts[low:high + 1]))
            key += held.bin[a:b]
            if not root:
                key *= room
                key += np.take(one.slot, entry)
            counts = in_root.get(low)
            if counts is None:
                counts = np.bincount(key, None, of[-1] * room).reshape(-1, room)[:, :m].astype(float)
            if root:  # all classes have the same
                in_root[low] = counts
            residuals = np.bincount(key, np.take(one.residual, entry), of[-1] * room).reshape(-1, room)[:, :m]
            gain = gains(counts, residuals, one.totals, of, least_rows)
            top = gain.max(axis=0)
            for j in np.flatnonzero(top > one.best * (1 + TIE)).tolist():
                at = int((gain[:, j] >= top[j] * (1 - TIE)).argmax())
                one.best[j], one.bins[j] = gain[at, j], first[low] + at
    return found


def gains(counts: np.ndarray, residuals: np.ndarray, totals: np.ndarray, first: np.ndarray,
          least_rows: int) -> np.ndarray:
    """The drop of the squared error by the boundary below every bin, per node; -1 where none is.

    ``first`` are the first bins of some features, and their end. Left of bin b are the rows
    without the feature and those in lower bins.
    """
    sizes, ends, n, total, right = np.diff(first), first[1:] - 1, totals[0], totals[1], []
    for sums in (counts, residuals):
        up_to = np.cumsum(sums, axis=0)
        above = np.repeat(up_to[ends], sizes, axis=0)
        above -= up_to
        above += sums
        right.append(above)
    n_right, right = right
    n_left, left = n - n_right, total - right
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left * n_right - right * n_left) ** 2 / (n * n_left * n_right)
    # A boundary below an empty bin is that below the next one.
    return np.where((counts > 0) & (n_left >= least_rows) & (n_right >= least_rows), gain, -1.0)


def leaf_value(stats: tuple[float, float, float], classes: int) -> float:
    _, residual, curvature = stats
    return float((classes - 1) / classes * residual / curvature) if curvature > 1e-150 else 0.0


def _right_rows(held: Columns, at: np.ndarray, node: int, bin: int, bins: Bins) -> np.ndarray:
    rows = held.right_of(bins, bin)
    return rows[at[rows] == node]


def _best_of_range(held: Columns, sent: Sent, active, bins: Bins, least_rows: int, with_rows: bool):
    """(class, node, split with its bin counted over all features, rows to the right or None)."""
    n = len(held.labels)
    rows = rows_now(sent, n)
    for one in best_boundaries(held, rows, active, bins, least_rows):
        at, k = rows.at[one.k], one.k
        for j in np.flatnonzero(one.bins >= 0).tolist():
            bin = int(one.bins[j] + bins.first[held.low])
            right = _right_rows(held, at, one.nodes[j], bin, bins)
            stats = float(len(right)), float(one.residual[right].sum()), float(one.curvature[right].sum())
            left = tuple(float(t - r) for t, r in zip(one.totals[:, j], stats))
            yield (k, one.nodes[j], Split(float(one.best[j]), bin, left, stats),
                   columns.pack(right, n) if with_rows else None)


def _chosen_rows(base, best: dict, sent: Sent, dealt: Dealt) -> dict[tuple[int, int], bytes]:
    """The rows to the right of the chosen splits, from the tasks that hold their features."""
    wanted: dict[int, list] = {}
    for (k, node), (split, _) in best.items():
        owner = int(np.searchsorted(dealt.cuts, dealt.bins.feature_of(split.bin), "right") - 1)
        wanted.setdefault(owner, []).append((k, node, split.bin))
    low, bins = {dealt.cuts[i]: asked for i, asked in wanted.items()}, dealt.sent

    def answer(ranges):
        for held in ranges:
            rows = rows_now(sent, len(held.labels))
            for k, node, bin in low[held.low]:
                right = _right_rows(held, rows.at[k], node, bin, bins.value)
                yield (k, node), columns.pack(right, len(held.labels))

    return dict(base.context.runJob(base, answer, sorted(wanted)))


def grow_round(base, dealt: Dealt, sent: Sent, config: BoostConfig) -> tuple[list[Tree], list]:
    """One tree per class, all grown together level by level, and the levels."""
    bins, n, to_tasks, least, classes = dealt.bins, dealt.rows, dealt.sent, config.min_leaf, len(sent.start)
    eager = (len(dealt.cuts) - 1) * classes * n / 8 <= EAGER
    trees = [Tree() for _ in range(classes)]
    active: list[list[int]] = [[0] for _ in range(classes)]
    levels: list[list[Level]] = []
    for _ in range(config.max_depth):
        if not any(active):
            break
        now = sent._replace(levels=tuple(levels))
        found = base.flatMap(lambda held, active=active, now=now: _best_of_range(
            held, now, active, to_tasks.value, least, eager)).collect()
        best: dict[tuple[int, int], tuple[Split, bytes | None]] = {}
        for k, node, split, rows in found:
            old = best.get((k, node))
            if old is None or split.gain > old[0].gain * (1 + TIE):  # ranges come in the order of their bins
                best[k, node] = split, rows
        if not best:
            break
        rows_right = {key: rows for key, (_, rows) in best.items()} if eager else \
            _chosen_rows(base, best, now, dealt)
        active = [[] for _ in range(classes)]
        done: list[tuple[list, list, list]] = [([], [], []) for _ in range(classes)]
        for (k, node), (split, _) in sorted(best.items(), key=lambda item: item[0]):
            tree = trees[k]
            feature = int(bins.feature_of(split.bin))
            children = tree.split(node, feature, bins.edge_below(split.bin),
                                  split.bin - int(bins.first[feature]), split.gain)
            tree.rows[node] = int(split.left[0] + split.right[0])
            for values, value in zip(done[k], (node, children[0], rows_right[k, node])):
                values.append(value)
            for child, stats in zip(children, (split.left, split.right)):
                tree.value[child] = leaf_value(stats, classes)
                tree.rows[child] = int(stats[0])
                if stats[0] >= config.min_split:
                    active[k].append(child)
        levels.append([Level(np.array(nodes, np.int32), np.array(left, np.int32),
                             columns.any_of(right, n) if right else b"")
                       for nodes, left, right in done])
    return trees, levels


class Scorer:
    """Raw scores of rows given by their non-zero entries, all trees descended together."""

    def __init__(self, start: list[float], trees: list[list[Tree]], step: float):
        every = [tree for round_ in trees for tree in round_]
        sizes = [len(tree.feature) for tree in every]
        self.start, self.step, self.classes = np.asarray(start, float), step, len(start)
        self.roots = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        self.feature = np.concatenate([tree.feature for tree in every] or [np.zeros(0, int)])
        self.edge = np.concatenate([tree.edge for tree in every] or [np.zeros(0)])
        self.value = np.concatenate([tree.value for tree in every] or [np.zeros(0)])
        left = np.concatenate([tree.left for tree in every] or [np.zeros(0, int)])
        self.left = left + np.repeat(self.roots, sizes)
        self.used = np.unique(self.feature[self.feature >= 0])
        self.slot = np.where(self.feature >= 0, np.searchsorted(self.used, self.feature), -1)

    def scores(self, counts: np.ndarray, indices: np.ndarray, values: np.ndarray) -> np.ndarray:
        scores = np.tile(self.start, (len(counts), 1))
        if len(self.roots):
            wide = columns.wide_rows(self.used, counts, indices, values)
            leaf = columns.leaves_of(self.left, self.slot, self.edge, self.roots, wide)
            for tree, value in enumerate(self.value[leaf]):
                scores[:, tree % self.classes] += self.step * value
        return scores


class SoftmaxBoostingModel(Model, HasFeaturesCol, MLWritable, MLReadable):
    """Boosted trees; adds ``probability`` (a vector) and ``prediction``."""

    def __init__(self, start: list[float] | None = None, trees: list[list[Tree]] | None = None,
                 step: float = 0.1):
        super().__init__()
        self.start, self.trees, self.step = start or [], trees or [], step

    @property
    def numClasses(self) -> int:
        return len(self.start)

    def table(self, spark: SparkSession) -> DataFrame:
        """All nodes as rows."""
        rows = [(t, k, i, tree.feature[i], tree.edge[i], tree.bin[i], tree.left[i], tree.right[i],
                 tree.value[i], tree.gain[i], tree.rows[i])
                for t, round_ in enumerate(self.trees) for k, tree in enumerate(round_)
                for i in range(len(tree.feature))]
        return spark.createDataFrame(rows, _TREES)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features, names = self.getFeaturesCol(), dataset.columns
        sent = dataset.sparkSession.sparkContext.broadcast((self.start, self.trees, self.step))

        def score(batches: Iterator[pa.RecordBatch]):
            scorer = Scorer(*sent.value)
            for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
                counts, indices, values, _ = blocks.entries(blocks.as_struct(b.column(features)))
                p = softmax(scorer.scores(counts, indices, values))
                n, k = p.shape
                vector = pa.StructArray.from_arrays(
                    [pa.array([1] * n, pa.int8()), pa.nulls(n, pa.int32()),
                     pa.nulls(n, pa.list_(pa.int32())),
                     pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), p.ravel())],
                    names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, vector, pa.array(p.argmax(axis=1).astype(float))],
                    names=[*names, "probability", "prediction"])

        out = T.StructType([*dataset.schema.fields, T.StructField("probability", VectorUDT()),
                            T.StructField("prediction", T.DoubleType())])
        return dataset.mapInArrow(score, out)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: SoftmaxBoostingModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(
            self.model, path, self.sparkSession,
            extraMetadata={"start": [float(s) for s in self.model.start], "step": self.model.step,
                           "rounds": len(self.model.trees)})
        self.model.table(self.sparkSession).coalesce(1).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SoftmaxBoostingModel:
        known = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        start = known["start"]
        trees = [[Tree(*[[] for _ in range(8)]) for _ in start] for _ in range(known["rounds"])]
        nodes = self.sparkSession.read.schema(_TREES).parquet(f"{path}/trees")
        for r in nodes.orderBy("round", "class", "node").collect():
            tree = trees[r["round"]][r["class"]]
            for name in ("feature", "edge", "bin", "left", "right", "value", "gain", "rows"):
                getattr(tree, name).append(r[name])
        model = self.cls(start, trees, known["step"])
        model._resetUid(known["uid"])
        DefaultParamsReader.getAndSetParams(model, known)
        return model


class SoftmaxBoosting(Estimator, HasFeaturesCol, HasLabelCol):
    """Trains :class:`SoftmaxBoostingModel`; labels are 0 to classes - 1."""

    def __init__(self, classes: int, id_col: str, config: BoostConfig = BoostConfig()):
        super().__init__()
        self.classes, self.id_col, self.config = classes, id_col, config

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostingModel:
        config, context = self.config, dataset.sparkSession.sparkContext
        features = self.getFeaturesCol()
        dealt = columns.deal(dataset, self.id_col, self.getLabelCol(), features, config.bins)
        shares = np.array([dealt.by_class.get(k, 0) for k in range(self.classes)], float) / dealt.rows
        start = np.log(np.maximum(shares, 1e-15))
        base = dealt.ranges.persist(StorageLevel.MEMORY_AND_DISK)
        sent, trees, latest = Sent(uuid4().hex, start, config.step, [], ()), [], []
        for _ in range(config.rounds):
            grown, levels = grow_round(base, dealt, sent, config)
            trees.append(grown)
            latest.append(([np.array(t.value) for t in grown], levels))
            old, rounds = [], [*sent.rounds, (context.broadcast(latest[-1:]), 1)]
            if len(latest) == REPLAY:
                old, rounds = rounds[-REPLAY:], [*rounds[:-REPLAY], (context.broadcast(latest), REPLAY)]
                latest = []
            sent = sent._replace(rounds=rounds)
            for some, _ in old:
                some.destroy()
        base.unpersist()
        for some, _ in sent.rounds:
            some.destroy()
        model = SoftmaxBoostingModel([float(s) for s in start], trees, config.step)
        return model._set(featuresCol=features)
