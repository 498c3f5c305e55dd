"""Feature rows as numpy blocks: what trainers with passes of their own work on.

A block holds the non-zero entries of some rows in row order. Rows are dealt to blocks
by a hash of their id, so the blocks of a table are the same on every run and a lost one
can be made again. Blocks are staged once; trainers map over them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from chorus.workspace import stage

#: Non-zero entries of a block, some 50 MB.
ENTRIES = 4_000_000
_SCHEMA = "part int, size int, indptr binary, indices binary, values binary, labels binary"


class Block(NamedTuple):
    indptr: np.ndarray  # row r has the entries indptr[r] to indptr[r + 1]
    indices: np.ndarray
    values: np.ndarray
    labels: np.ndarray
    size: int  # number of features

    def row_of_entry(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.labels)), np.diff(self.indptr))


def entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entry counts per row, feature numbers, values and the number of features.

    Sparse and dense vectors may be mixed; entries that are zero are left out.
    """
    kinds = vectors.field("type").to_numpy(zero_copy_only=False)
    lists = vectors.field("values")
    counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    dense = kinds == 1
    if dense.any():
        held = [np.asarray(i, np.int32) if not d else np.arange(n, dtype=np.int32)
                for i, d, n in zip(vectors.field("indices").to_pylist(), dense, counts)]
        indices = np.concatenate(held) if held else np.zeros(0, np.int32)
        size = int(counts[dense].max())
    else:
        indices = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
        size = int(vectors.field("size").to_numpy(zero_copy_only=False).max()) if len(kinds) else 0
    there = values != 0
    if not there.all():
        row = np.repeat(np.arange(len(counts)), counts)[there]
        counts, indices, values = np.bincount(row, minlength=len(counts)), indices[there], values[there]
    return counts, indices.astype(np.int32), values, size


def as_struct(column: pa.Array) -> pa.StructArray:
    """A column of vectors as type, size, indices and values."""
    return column.storage if isinstance(column, pa.ExtensionArray) else column


def table_size(rows: DataFrame, features: str = "features") -> tuple[int, int]:
    """Rows and non-zero entries."""
    def count(batches: Iterator[pa.RecordBatch]):
        n = nnz = 0
        for b in batches:
            if b.num_rows:
                n, nnz = n + b.num_rows, nnz + int(entries(as_struct(b.column(0)))[0].sum())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()),
                                          "nnz": pa.array([nnz], pa.int64())})

    total = rows.select(features).mapInArrow(count, "n long, nnz long").agg(
        F.sum("n"), F.sum("nnz")).first()
    return total[0] or 0, total[1] or 0


def long_form(rows: DataFrame, features: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """(kept columns, feature, value) of every non-zero entry."""
    def unfold(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                counts, indices, values, _ = entries(as_struct(b.column(features)))
                row = pa.array(np.repeat(np.arange(b.num_rows), counts))
                yield pa.RecordBatch.from_pydict({
                    **{c: b.column(c).take(row) for c in keep}, "feature": indices, "value": values})

    out = T.StructType([*[rows.schema[c] for c in keep], T.StructField("feature", T.IntegerType()),
                        T.StructField("value", T.DoubleType())])
    return rows.select(*keep, features).mapInArrow(unfold, out)


def row_blocks(rows: DataFrame, id_col: str, label: str, parts: int,
               features: str = "features") -> DataFrame:
    """The rows as ``parts`` staged blocks, one row each."""
    def gather(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        counts, indices, values, labels, size = [], [], [], [], 0
        for b in batches:
            if b.num_rows:
                c, i, v, s = entries(as_struct(b.column("features")))
                counts.append(c)
                indices.append(i)
                values.append(v)
                labels.append(b.column("label").to_numpy(zero_copy_only=False).astype(np.int32))
                size = max(size, s)
        if counts:
            made = [np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64),
                    np.concatenate(indices).astype(np.int32),
                    np.concatenate(values).astype(np.float64), np.concatenate(labels)]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                "size": pa.array([size], pa.int32()),
                **{name: pa.array([a.tobytes()], pa.binary())
                   for name, a in zip(("indptr", "indices", "values", "labels"), made)}})

    dealt = (rows.select(F.col(label).alias("label"), F.col(features).alias("features"), id_col)
             .repartition(parts, F.xxhash64(id_col)).select("label", "features"))
    return stage(dealt.mapInArrow(gather, _SCHEMA), "feature-blocks")


def block(row) -> Block:
    """A staged row as arrays."""
    return Block(np.frombuffer(row["indptr"], np.int64), np.frombuffer(row["indices"], np.int32),
                 np.frombuffer(row["values"], np.float64), np.frombuffer(row["labels"], np.int32),
                 row["size"])
