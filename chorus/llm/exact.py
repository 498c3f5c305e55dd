"""Exact de-duplication by counting quotient filters (operator 4).

Each text, without white space, has a 64-bit fingerprint. A fingerprint is cut
into a quotient, whose leading bits choose a range, and a remainder. Every task
builds one counting quotient filter per range: occupied quotients as bits, run
lengths in unary, remainders sorted inside their run and a counter for those
that occur more than once. A filter holds its fingerprints without loss, so the
filters of a range merge by walking their sorted remainders and adding counters.

Fingerprints with a count above one route their texts to the byte check:
grouping by the normalised text itself, which collapses copies inside each task
before the shuffle, so a group with a third of all rows sends one row per task.

Defined results: a null text counts as empty; empty texts form one group; a
missing id sorts after all others; repeated rows each count in ``group_size``
and are all ``kept`` if they are equal to the row that stays. An empty table
gives an empty result. Other columns of the input are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chorus.llm.common import WHITE, stage

RANGE_BITS = 8
QUOTIENT_BITS = 20  # per filter, below the range bits
REMAINDER_BITS = 64 - RANGE_BITS - QUOTIENT_BITS
FLUSH = 1 << 21


def pack(fingerprints: np.ndarray, counts: np.ndarray) -> bytes:
    """One filter from sorted, distinct fingerprints of one range."""
    quotients = (fingerprints >> np.uint64(REMAINDER_BITS)) & np.uint64((1 << QUOTIENT_BITS) - 1)
    remainders = fingerprints & np.uint64((1 << REMAINDER_BITS) - 1)
    starts = np.flatnonzero(np.r_[True, quotients[1:] != quotients[:-1]])
    runs = np.diff(np.r_[starts, len(quotients)])
    occupied = quotients[starts].astype(np.uint32)
    run_ends = np.zeros(len(quotients), np.uint8)
    run_ends[np.cumsum(runs) - 1] = 1
    repeated = counts > 1
    head = np.array([len(occupied), len(remainders), int(repeated.sum())], np.uint32)
    low = remainders.view(np.uint8).reshape(-1, 8)[:, :(REMAINDER_BITS + 7) // 8]
    return b"".join((head.tobytes(), occupied.tobytes(), np.packbits(run_ends).tobytes(),
                     low.tobytes(), np.packbits(repeated).tobytes(),
                     counts[repeated].astype(np.uint64).tobytes()))


def unpack(blob: bytes, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints and counters of a filter."""
    n_runs, n, n_repeated = (int(x) for x in np.frombuffer(blob, np.uint32, 3))
    at, width, bits = 12, (REMAINDER_BITS + 7) // 8, (n + 7) // 8
    occupied = np.frombuffer(blob, np.uint32, n_runs, at).astype(np.uint64)
    at += 4 * n_runs
    run_ends = np.unpackbits(np.frombuffer(blob, np.uint8, bits, at), count=n)
    at += bits
    low = np.zeros((n, 8), np.uint8)
    low[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    repeated = np.unpackbits(np.frombuffer(blob, np.uint8, bits, at), count=n).astype(bool)
    at += bits
    counts = np.ones(n, np.uint64)
    counts[repeated] = np.frombuffer(blob, np.uint64, n_repeated, at)
    run = np.cumsum(run_ends) - run_ends
    high = (np.uint64(part) << np.uint64(QUOTIENT_BITS)) | occupied[run]
    return (high << np.uint64(REMAINDER_BITS)) | low.view(np.uint64).ravel(), counts


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted filters of one range: equal remainders add their counters."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")  # a merge of sorted runs
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _build(batches):
    def filters(held):
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        ranges = (keys >> np.uint64(64 - RANGE_BITS)).astype(np.int32)
        cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])
        ends = np.r_[cuts[1:], len(keys)]
        return pa.RecordBatch.from_pydict(
            {"part": pa.array(ranges[cuts], pa.int32()),
             "filter": pa.array([pack(keys[a:b], counts[a:b]) for a, b in zip(cuts, ends)],
                                pa.binary())})

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
        if n >= FLUSH:
            yield filters(held)
            held, n = [], 0
    if n:
        yield filters(held)


def _merge(table: pa.Table) -> pa.Table:
    part = table["part"][0].as_py()
    keys, counts = None, None
    for blob in table["filter"]:
        one = unpack(blob.as_py(), part)
        keys, counts = one if keys is None else merge([(keys, counts), one])
    more = counts > 1
    return pa.table({"fp": pa.array(keys[more].view(np.int64), pa.int64()),
                     "seen": pa.array(counts[more].astype(np.int64), pa.int64())})


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fp, seen) of the fingerprints that occur more than once in a column ``fp``."""
    return (fingerprints.select("fp").mapInArrow(_build, "part int, filter binary")
            .groupBy("part").applyInArrow(_merge, "fp long, seen long"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its group of equal texts and the row that stays."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.length(text).alias("chars"),
                        F.translate(text, WHITE, "").alias("norm"))
    texts = texts.select("*", F.xxhash64("norm").alias("fp"))
    rows = stage(texts.select("id", "chars", "fp", F.sha2("norm", 256).alias("sha")), "exact-rows")
    repeated = stage(repeated_fingerprints(rows).select("fp"), "exact-repeated")
    verified = (texts.join(repeated, "fp").groupBy("fp", "norm")
                .agg(F.max(F.struct("chars", F.bitwise_not("id").alias("back"))).alias("best"),
                     F.count("*").alias("size"))
                .select("fp", F.sha2("norm", 256).alias("sha"), "size", "best"))
    return (rows.join(verified, ["fp", "sha"], "left")
            .select(F.col("id").alias("doc_id"),
                    F.when(F.col("size").isNull(), F.col("id"))
                    .otherwise(F.bitwise_not("best.back")).alias("keep_id"),
                    F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                    (F.col("size").isNull()
                     | ((F.col("best.chars") == F.col("chars"))
                        & F.bitwise_not("best.back").eqNullSafe(F.col("id")))).alias("kept"),
                    F.col("sha").alias("text_sha256")))
