"""Feature rows as columns of bins, dealt by feature: what growers of trees work on.

A task holds some columns for all rows, so that it finds the best boundaries of its features
alone and no histogram is shuffled. What moves is one bit per row and split: whether the
row goes right. The values of a feature fall into quantile bins, zero is a bin of its own
below them, and a split "value > edge" is a boundary between two bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from chorus.plans import blocks


class Bins(NamedTuple):
    """Edges of all features, one after the other; feature f has the bins from first[f]."""

    edges: np.ndarray
    edge_at: np.ndarray  # feature f has the edges edge_at[f] to edge_at[f + 1]
    first: np.ndarray

    def feature_of(self, bin):
        return np.searchsorted(self.first, bin, "right") - 1

    def edge_below(self, bin: int) -> float:
        """The value a row must exceed to lie in this bin or a higher one of its feature."""
        f = int(self.feature_of(bin))
        j = bin - self.first[f]
        return float(self.edges[self.edge_at[f] + j - 1]) if j else 0.0


def make_bins(per_feature: dict[int, list[float]], size: int) -> Bins:
    held = [np.unique(np.asarray(per_feature.get(f, ()), np.float64)) for f in range(size)]
    counts = np.array([len(e) for e in held], np.int64)
    edge_at = np.concatenate([[0], np.cumsum(counts)])
    first = np.concatenate([[0], np.cumsum(counts + 1)])
    return Bins(np.concatenate(held) if held else np.zeros(0), edge_at, first)


def feature_bins(rows: DataFrame, size: int, most: int) -> tuple[Bins, np.ndarray]:
    """Quantile bins of the non-zero values of every feature, at most ``most`` edges each, and their number.

    They come in one job: fetched one partition after the other, each is a job.
    """
    shares = [i / most for i in range(1, most + 1)]
    found = blocks.long_form(rows).groupBy("feature").agg(
        F.percentile_approx("value", F.array(*[F.lit(s) for s in shares]), 1000).alias("edges"),
        F.count(F.lit(1)).alias("n")).toArrow()
    features, entries = found["feature"].to_numpy(), np.zeros(size, np.int64)
    entries[features] = found["n"].to_numpy()
    ends = np.cumsum(found["edges"].combine_chunks().value_lengths().to_numpy())
    edges = np.split(found["edges"].combine_chunks().flatten().to_numpy(), ends[:-1]) if len(ends) else []
    return make_bins(dict(zip(features.tolist(), edges)), size), entries


class Columns(NamedTuple):
    """The entries of the features from ``low`` to ``high``, by feature and row."""

    labels: np.ndarray  # of all rows
    low: int
    high: int
    starts: np.ndarray  # feature low + j has the entries starts[j] to starts[j + 1]
    rows: np.ndarray
    bin: np.ndarray  # counted from the first of its feature, in as few bytes as hold it

    def places(self, bins: Bins) -> np.ndarray:
        """The bins of the entries, counted from the first of feature ``low``."""
        first = bins.first[self.low:self.high] - bins.first[self.low]
        places = np.repeat(first.astype(np.intp), np.diff(self.starts))
        places += self.bin
        return places

    def right_of(self, bins: Bins, bin: int) -> np.ndarray:
        """The rows in ``bin`` or a higher one of its feature."""
        f = int(bins.feature_of(bin))
        a, b = self.starts[f - self.low], self.starts[f - self.low + 1]
        return self.rows[a:b][self.bin[a:b] >= bin - bins.first[f]]


def even_cuts(widths: np.ndarray, ranges: int) -> list[int]:
    """Feature numbers that cut the widths into ranges of like size."""
    ends = np.cumsum(widths)
    cuts = [0, *np.searchsorted(ends, ends[-1] * np.arange(1, ranges) / ranges).tolist(), len(widths)]
    return sorted(set(cuts))


class Dealt(NamedTuple):
    """Columns of all rows, one element and partition per range of features."""

    ranges: object  # RDD of Columns
    cuts: list[int]
    bins: Bins
    sent: object  # the bins, broadcast
    rows: int
    by_class: dict[int, int]


def deal(dataset: DataFrame, id_col: str, label: str, features: str, most: int) -> Dealt:
    """Rows to columns: staged as blocks of rows, then cut by feature, which moves them once."""
    context = dataset.sparkSession.sparkContext
    rows = dataset.select(id_col, label, F.col(features).alias("features"))
    n, nnz = blocks.table_size(rows)
    if not n:
        raise ValueError("trees need training rows")
    parts = -(-nnz // blocks.ENTRIES) or 1
    staged = blocks.row_blocks(rows, id_col, label, parts)
    size = staged.agg(F.max("size")).first()[0]
    bins, entries = feature_bins(rows, size, most)
    sizes = {r[0]: r[1] // 4 for r in staged.select("part", F.octet_length("labels")).collect()}
    offsets = dict(zip(sorted(sizes), np.cumsum([0, *[sizes[p] for p in sorted(sizes)]]).tolist()))
    at_once = context.defaultParallelism  # no task of a level is left for a round of its own
    cuts = even_cuts(entries + 1, min(at_once * -(-parts // at_once), size))
    sent = context.broadcast(bins)

    def cut(row):
        block, bins = blocks.block(row), sent.value
        if len(block.values) and block.values.min() < 0:
            raise ValueError("trees take features that are zero or positive")
        order = np.argsort(block.indices, kind="stable")
        indices, values = block.indices[order], block.values[order]
        starts = np.searchsorted(indices, np.arange(len(bins.first)))
        bin = np.empty(len(indices), np.min_scalar_type(int(np.diff(bins.first).max())))
        for f in np.flatnonzero(np.diff(starts)):
            a, b = starts[f], starts[f + 1]
            edges = bins.edges[bins.edge_at[f]:bins.edge_at[f + 1]]
            bin[a:b] = np.searchsorted(edges, values[a:b], "left")
        at = (block.row_of_entry()[order] + offsets[row["part"]]).astype(np.int32)
        for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
            a, b = starts[low], starts[high]
            yield i, (row["part"], block.labels, np.diff(starts[low:high + 1]), at[a:b], bin[a:b])

    def gather(messages):
        found = list(messages)
        if found:
            i, held = found[0][0], sorted((m for _, m in found), key=lambda m: m[0])
            low, high = cuts[i], cuts[i + 1]
            column = np.concatenate([np.repeat(np.arange(high - low), m[2]) for m in held])
            order = np.argsort(column, kind="stable")
            yield Columns(np.concatenate([m[1] for m in held]), low, high,
                          np.searchsorted(column[order], np.arange(high - low + 1)),
                          np.concatenate([m[3] for m in held])[order],
                          np.concatenate([m[4] for m in held])[order])

    ranges = staged.rdd.flatMap(cut).partitionBy(len(cuts) - 1, lambda i: i).mapPartitions(gather)
    by_class = {int(r[0]): r[1] for r in rows.groupBy(label).count().collect()}
    return Dealt(ranges, cuts, bins, sent, n, by_class)


def pack(rows: Sequence[int], n: int) -> bytes:
    """One bit per row of the table, set for those given."""
    there = np.zeros(n, bool)
    there[rows] = True
    return zlib.compress(np.packbits(there).tobytes(), 1)


def unpack(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n).view(bool)


def any_of(packed: list[bytes], n: int) -> bytes:
    """Rows given by any of several."""
    if len(packed) == 1:
        return packed[0]
    there = np.zeros(-(-n // 8), np.uint8)
    for bits in packed:
        there |= np.frombuffer(zlib.decompress(bits), np.uint8)
    return zlib.compress(there.tobytes(), 1)


class Level(NamedTuple):
    """What one level did to a tree: children of the nodes that were split, and who goes right."""

    nodes: np.ndarray
    left: np.ndarray  # the right child follows
    right_rows: bytes

    def descend(self, at: np.ndarray) -> np.ndarray:
        """The nodes of the rows after the level, from those before."""
        if not len(self.nodes):
            return at
        child = np.arange(max(int(at.max(initial=0)), int(self.nodes.max())) + 1, dtype=np.int32)
        moved = np.zeros(len(child), bool)
        child[self.nodes], moved[self.nodes] = self.left, True
        right = unpack(self.right_rows, len(at)) & moved[at]
        return child[at] + right


def leaves_of(trees_left: np.ndarray, feature: np.ndarray, edge: np.ndarray, roots: np.ndarray,
              wide: np.ndarray) -> np.ndarray:
    """The leaf of every tree and row; nodes of all trees lie one after the other.

    ``wide`` has a row per feature slot that ``feature`` names (-1: a leaf).
    """
    at = np.repeat(roots[:, None], wide.shape[1], axis=1)
    row = np.arange(wide.shape[1])[None, :]
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return at
        over = wide[np.where(inner, f, 0), row] > edge[at]
        at = np.where(inner, trees_left[at] + over, at)


def wide_rows(used: np.ndarray, counts: np.ndarray, indices: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of the used features (sorted), a row per feature and a column per row."""
    wide = np.zeros((max(len(used), 1), len(counts)))
    slot = np.searchsorted(used, indices)
    known = np.zeros(len(indices), bool)
    inside = slot < len(used)
    known[inside] = used[slot[inside]] == indices[inside]
    row = np.repeat(np.arange(len(counts)), counts)
    wide[slot[known], row[known]] = values[known]
    return wide
