"""Approximate nearest neighbours by collision-counting hashing (operator 5).

Every vector is projected on ``PROJECTIONS`` random lines. The index keeps, for
each shard of the vectors, one sorted array per line. A query expands a window
around its own projection on every line; virtual rehashing widens the windows by
a factor and only counts what a round adds. A vector that lies inside the windows
of at least ``THRESHOLD`` lines is verified by its exact distance. A shard is done
with a query when the k-th verified distance is within the radius the windows
stand for, or everything has been verified.

At half-width equal to the radius a vector within the radius falls into a window
with probability 0.68 and so passes the threshold with probability 0.97 or more,
which is what the recall rests on; the tests measure it against brute force.

Every valid row is indexed. Shards are dealt by a hash of the id, so equal vectors
spread. Queries are a frame too, dealt to blocks of some ``BLOCK`` vectors; a task
takes one shard and one block, so neither side passes the driver or is broadcast.
Results are cut to k inside each task before they move.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, neither as query nor as candidate; neither do rows
without an id. Vectors are compared with those of their own dimension only. A row
is no candidate for queries with its own id. Ties go to the smaller id. If rows repeat
a query id, each of its different vectors is a query with ranks of its own, told apart
by ``query_key``, a hash of the vector; equal rows are one query. Repeated rows are a
candidate each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chorus.llm.common import stage

PROJECTIONS = 40
THRESHOLD = 22
WIDEN = 1.25
FIRST_SHARE = 0.02  # share of a shard inside the first windows
SHARD = 16_384
BLOCK = 4_096
LEAST_BLOCKS = 4  # so that few shards still make many tasks
SEED = 7
SALTS = 32
FOUND = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()),
                   ("score", pa.float64()), ("salt", pa.int32())])


def lines(dimension: int) -> np.ndarray:
    """The random lines, alike on every machine."""
    return np.random.default_rng([SEED, dimension]).standard_normal((PROJECTIONS, dimension))


class Shard:
    """Vectors of a shard and one sorted array per line."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        projected = vectors.astype(np.float64) @ lines(vectors.shape[1]).T
        self.order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(projected.T, self.order.astype(np.int64), axis=1)

    def prepared(self):
        # One sorted array over all lines: the values of a line lie between its two bounds.
        spread = float(np.abs(self.sorted).max()) * 4 + 1.0
        base = np.arange(PROJECTIONS) * spread
        return (self.sorted + base[:, None]).ravel(), base, spread, self.order.ravel()

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query number, vector number, distance) of up to k neighbours of each query."""
        n = len(self.ids)
        flat, base, spread, order = self.prepared()
        centres = queries.astype(np.float64) @ lines(queries.shape[1]).T
        vectors = self.vectors.astype(np.float64)
        starts, ends = np.arange(PROJECTIONS) * n, (np.arange(PROJECTIONS) + 1) * n
        edge = spread * 0.45
        first = np.median(self.sorted[:, -1] - self.sorted[:, 0]) * FIRST_SHARE or 1e-9
        found = []
        for q in range(len(queries)):
            centre = np.clip(centres[q], -edge, edge) + base
            low = high = np.searchsorted(flat, centre)
            low, high = np.clip(low, starts, ends), np.clip(high, starts, ends)
            counts, verified = np.zeros(n, np.int32), np.zeros(n, bool)
            numbers, distances, radius = [], [], first
            while True:
                if radius < spread:
                    new_low = np.clip(np.searchsorted(flat, centre - radius, "left"), starts, low)
                    new_high = np.clip(np.searchsorted(flat, centre + radius, "right"), high, ends)
                else:  # as wide as a line is, however far off the query
                    new_low, new_high = starts, ends
                added = [order[a:b] for a, b in zip(new_low.tolist(), low.tolist()) if b > a]
                added += [order[a:b] for a, b in zip(high.tolist(), new_high.tolist()) if b > a]
                low, high = new_low, new_high
                if added:
                    counts += np.bincount(np.concatenate(added), minlength=n)
                fresh = np.flatnonzero((counts >= THRESHOLD) & ~verified)
                if len(fresh):
                    verified[fresh] = True
                    apart = vectors[fresh] - queries[q]
                    numbers.append(fresh)
                    distances.append(np.sqrt((apart * apart).sum(axis=1)))
                done = bool(np.all(low == starts) and np.all(high == ends))
                if numbers and not done:
                    all_d = np.concatenate(distances)
                    own = np.count_nonzero(self.ids[np.concatenate(numbers)] == query_ids[q])
                    done = np.count_nonzero(all_d <= radius) >= k + own
                if done:
                    break
                radius *= WIDEN
            if numbers:
                numbers, distances = np.concatenate(numbers), np.concatenate(distances)
                other = self.ids[numbers] != query_ids[q]
                numbers, distances = numbers[other], distances[other]
                best = np.lexsort((self.ids[numbers], distances))[:k]
                found.append((np.full(len(best), q), numbers[best], distances[best]))
        if not found:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return tuple(np.concatenate(x) for x in zip(*found))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("id")
    ids = table["id"].to_numpy()
    flat = pa.concat_arrays([c.flatten() for c in table["vector"].chunks]).to_numpy()
    shard = Shard(ids, flat.reshape(len(ids), -1))
    return pa.table({
        "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
        "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
        "vectors": pa.array([shard.vectors.astype("<f8").tobytes()], pa.binary()),
        "order": pa.array([shard.order.astype("<i4").tobytes()], pa.binary()),
        "sorted": pa.array([shard.sorted.astype("<f8").tobytes()], pa.binary())})


def _load(row: dict) -> Shard:
    shard = Shard.__new__(Shard)
    shard.ids = np.frombuffer(row["ids"], "<i8")
    n = len(shard.ids)
    shard.vectors = np.frombuffer(row["vectors"], "<f8").reshape(n, -1)
    shard.order = np.frombuffer(row["order"], "<i4").reshape(PROJECTIONS, n)
    shard.sorted = np.frombuffer(row["sorted"], "<f8").reshape(PROJECTIONS, n)
    return shard


def build_index(vectors: DataFrame) -> DataFrame:
    """One staged row per shard of (id, vector) rows of one dimension."""
    shards = max(8, -(-vectors.count() // SHARD))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return stage(dealt.groupBy("shard").applyInArrow(
        _build, "shard int, ids binary, vectors binary, order binary, sorted binary"), "neighbour-index")


def _search(k: int):
    def run(shards: pa.Table, queries: pa.Table) -> pa.Table:
        keys, best = queries["key"].to_numpy(), []
        if queries.num_rows:
            ids = queries["id"].to_numpy()
            flat = pa.concat_arrays([c.flatten() for c in queries["vector"].chunks]).to_numpy()
            block = flat.reshape(len(ids), -1)
            for row in shards.to_pylist():
                shard = _load(row)
                q, at, distance = shard.nearest(ids, block, k)
                best.append((ids[q], keys[q], shard.ids[at], distance,
                             np.full(len(q), row["shard"] % SALTS)))
        columns = [np.concatenate(x) for x in zip(*best)] if best else [[]] * len(FOUND)
        return pa.table([pa.array(x, t) for x, t in zip(columns, FOUND.types)], schema=FOUND)
    return run


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Up to k neighbours per query and shard; ``queries`` has id, key and vector."""
    spark = index.sparkSession
    shards = index.agg(F.max("shard")).first()[0] + 1
    blocks = max(LEAST_BLOCKS, -(-queries.count() // BLOCK))
    # Pairs differ little in size and none may share a task because its rows are few.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pair = ["shard", "block"]
    left = (index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            .repartition(parts, *pair))
    right = (queries.withColumn("block", F.pmod(F.xxhash64("id", "key"), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
             .repartition(parts, *pair))
    return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(
        _search(k), "query_id long, query_key long, vec_id long, score double, salt int")


def _best(df: DataFrame, k: int, *by: str) -> DataFrame:
    one = F.struct("score", "vec_id")
    return (df.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list(one)), 1, k).alias("best"))
            .select(*by, F.posexplode("best").alias("at", "b"))
            .select(*by, (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score"))


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id",
                       vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of every row whose id is divisible by ``every``."""
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"),
                           F.col(vector_col).cast("array<double>").alias("vector"))
            .filter(F.col("id").isNotNull() & usable(F.col("vector"))))
    found = None
    for (dimension,) in rows.select(F.size("vector")).distinct().collect():
        same = rows.filter(F.size("vector") == dimension)
        wanted = (same.filter(F.col("id") % every == 0).distinct()
                  .select("id", F.xxhash64("vector").alias("key"), "vector"))
        part = search(build_index(same), wanted, k)
        found = part if found is None else found.unionByName(part)
    columns = ["query_id", "rank", "vec_id", "score", "query_key"]
    if found is None:
        return vectors.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score double, query_key long")
    query = ["query_id", "query_key"]
    return _best(_best(found, k, *query, "salt"), k, *query).select(*columns)
