"""Near-duplicates by SimHash and meet-in-the-middle ball hashing (operator 3).

Fingerprints that differ in at most three bits meet in a variant that is at most
one flip away from one of them and two flips away from the other:

* pairs up to two bits apart meet in a variant within one flip of both;
* pairs three bits apart have odd distance, so one has an even number of set bits
  and one an odd number. The even one alone emits the variants two flips away.

Variants are shuffled by their leading ``bits`` bits: a route says how many of the
flips lie there, and the task that owns these leading bits makes the remaining
flips itself. What is shuffled is so the routes, some dozens per fingerprint, and
not the two thousand variants. Leading bits whose group is large are routed again
by more bits; a full variant has at most 65 + 2,016 fingerprints near it, so
groups are bounded however dense the fingerprints lie.

Equal fingerprints are one node before anything is emitted. Fingerprints that
share a variant are linked in a star, never in pairs, each link is verified by its
number of differing bits, and a group only returns a spanning forest. Components
follow from alternating large and small stars over staged link tables.

Defined results: a null or empty text has fingerprint zero and links like any
other; texts with fewer words than a shingle hash their whole word sequence;
repeated rows give equal rows; a missing id counts as larger than any other for
the smallest id of a component and is null if the component has no id; an empty
table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chorus.llm.common import LAST_ID, order_id, stage, tuples, utf8

SHINGLE = 3
SEED = 42
GROUP = 1_000_000  # routes of one group; larger ones are routed by more bits
MORE_BITS = 8
VARIANTS_AT_ONCE = 1 << 21
SIEVE_BITS = 20


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles: a bit is 1 if set in over half the hashes."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.r_[0, ends[:-1] + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED)
                  for a, b in zip(starts[:1 - shingle].tolist(), ends[shingle - 1:].tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    def run(batch, _):
        made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        return {"doc_id": batch.column(0), "fp": made.view(np.int64)}

    return tuples(docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t")),
                  run, "doc_id long, fp long")


def _masks(bits: int) -> list[int]:
    """Flips of at most two of so many bits."""
    return [0, *(1 << i for i in range(bits)),
            *((1 << i) | (1 << j) for i, j in combinations(range(bits), 2))]


def _allowed(flips):
    """Odd fingerprints make one flip in all, even ones two."""
    return flips <= F.lit(2) - F.col("odd")


def _first_routes(nodes: DataFrame, bits: int) -> DataFrame:
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(bits)])
    lead = F.shiftrightunsigned("fp", 64 - bits)
    return (nodes.select("fp", (F.bit_count("fp") % 2).alias("odd"), F.explode(masks).alias("m"))
            .select("fp", "odd", F.bit_count("m").alias("flips"),
                    lead.bitwiseXOR(F.col("m")).alias("key"))
            .filter(_allowed(F.col("flips"))))


def _longer_routes(routes: DataFrame, bits: int, more: int) -> DataFrame:
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(more)])
    following = F.shiftrightunsigned("fp", 64 - bits - more).bitwiseAND(F.lit((1 << more) - 1))
    return (routes.select("fp", "odd", "flips", "key", F.explode(masks).alias("m"))
            .select("fp", "odd", (F.col("flips") + F.bit_count("m")).alias("flips"),
                    F.shiftleft("key", more).bitwiseOR(following.bitwiseXOR(F.col("m")))
                    .alias("key"))
            .filter(_allowed(F.col("flips"))))


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable node of each of ``n`` nodes under the links a - b."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        least, new = np.minimum(la, lb), label.copy()
        np.minimum.at(new, la, least)
        np.minimum.at(new, lb, least)
        while True:
            shorter = new[new]
            if np.array_equal(shorter, new):
                break
            new = shorter
        if np.array_equal(new, label):
            return label
        label = new


def _sieve(values: np.ndarray) -> np.ndarray:
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def links(fps: np.ndarray, flips: np.ndarray, low_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the fingerprints of a group that meet in a variant.

    All have the same leading bits after ``flips`` flips there; the remaining
    flips are made among the ``low_bits`` others.
    """
    low = fps & np.uint64((1 << low_bits) - 1)
    one = np.array([1 << i for i in range(low_bits)], np.uint64)
    two = np.array([(1 << i) | (1 << j) for i, j in combinations(range(low_bits), 2)], np.uint64)
    none = np.zeros(1, np.uint64)
    near = [np.flatnonzero(flips == 0), np.flatnonzero(flips == 1)]
    values = np.concatenate([(low[near[0], None] ^ np.r_[none, one][None]).ravel(), low[near[1]]])
    owner = np.concatenate([np.repeat(near[0], low_bits + 1), near[1]])
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    if not len(values):
        return fps[:0], fps[:0]
    first = np.r_[True, values[1:] != values[:-1]]
    heads = owner[np.flatnonzero(first)]
    star = ~first
    ends = [(owner[star], heads[np.cumsum(first) - 1][star])]
    distinct = values[first]
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[_sieve(distinct)] = True

    even = np.bitwise_count(fps) % 2 == 0
    label = local_labels(len(fps), *ends[0])
    for flipped, moves in ((0, two), (1, one), (2, none)):
        rows = np.flatnonzero(even & (flips == flipped))
        if not len(moves):
            continue
        step = max(1, VARIANTS_AT_ONCE // len(moves))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            made = (low[some, None] ^ moves[None]).ravel()
            hit = np.flatnonzero(sieve[_sieve(made)])
            where = np.minimum(np.searchsorted(distinct, made[hit]), len(distinct) - 1)
            same = distinct[where] == made[hit]
            a, b = some[hit[same] // len(moves)], heads[where[same]]
            near_enough = np.bitwise_count(fps[a] ^ fps[b]) <= 3
            a, b = a[near_enough], b[near_enough]
            # The forest so far stands for all earlier links.
            nodes = np.flatnonzero(label != np.arange(len(fps)))
            label = local_labels(len(fps), np.r_[a, nodes], np.r_[b, label[nodes]])
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def _meet(bits: int):
    def run(table: pa.Table) -> pa.Table:
        fps = table["fp"].to_numpy().view(np.uint64)
        u, v = links(fps, table["flips"].to_numpy().astype(np.int64), 64 - bits)
        return pa.table({"u": pa.array(u.view(np.int64), pa.int64()),
                         "v": pa.array(v.view(np.int64), pa.int64())})
    return run


def leading_bits(nodes: int) -> int:
    """Bits to route by: small groups for few nodes, larger ones for many."""
    few = max(4, min(12, round(np.log2(max(nodes, 1) / 64)))) if nodes else 4
    return int(max(few, np.ceil(np.log2(max(nodes, 1) / 100_000))))


def near_pairs(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (u, v), enough to connect all distinct fingerprints at most 3 bits apart."""
    bits = leading_bits(nodes.count())
    routes, found = _first_routes(nodes, bits), None
    while True:
        hot = stage(routes.groupBy("key").agg(F.count("*").alias("n"))
                    .filter(F.col("n") > group).select("key"), "simhash-hot")
        ends_here = hot.isEmpty() or bits >= 64
        cold = routes if ends_here else routes.join(hot, "key", "left_anti")
        here = cold.groupBy("key").applyInArrow(_meet(bits), "u long, v long")
        found = here if found is None else found.unionByName(here)
        if ends_here:
            return found
        more = min(MORE_BITS, 64 - bits)
        routes = _longer_routes(routes.join(hot, "key", "left_semi"), bits, more)
        bits += more


def components(edges: DataFrame) -> DataFrame:
    """(u, v): the smallest node v of the component of each node u that isn't it."""
    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if not large:
            both = both.filter(F.col("u") > F.col("v"))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select(
            "u", F.least("u", "low").alias("low"))
        joined = both.join(least, "u")
        moved = joined.filter(F.col("v") > F.col("u")) if large else joined
        out = moved.select(F.col("v").alias("u"), F.col("low").alias("v"))
        if not large:
            out = out.unionByName(least.select("u", F.col("low").alias("v")))
        return out.filter(F.col("u") != F.col("v")).distinct()

    def mark(links: DataFrame):
        return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = stage(edges.distinct(), "components")
    seen = mark(now)
    while seen[0]:
        now = stage(star(star(now, True), False), "components")
        before, seen = seen, mark(now)
        if before == seen:
            break
    return now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id and the size of the component of every row."""
    rows = stage(fingerprints(docs, id_col, text_col), "simhash-rows")
    nodes = stage(rows.groupBy("fp").agg(F.min(order_id()).alias("least"),
                                         F.count("*").alias("n")), "simhash-nodes")
    roots = components(near_pairs(nodes.select("fp")))
    placed = (nodes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
              .select("fp", F.coalesce("root", "fp").alias("root"), "least", "n"))
    groups = placed.groupBy("root").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    named = stage(placed.select("fp", "root").join(groups, "root").select("fp", "least", "n"),
                  "simhash-groups")
    return (rows.join(named, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.when(F.col("least") != LAST_ID, F.col("least")).alias("component_id"),
                    F.col("n").alias("component_size")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the document of the smallest id of each component.

    Rows that repeat an id are one document and stay or go together. Only ids are
    grouped; the texts move once, to meet the ids that stay.
    """
    groups = near_duplicates(docs, id_col, text_col)
    stay = (groups.filter(F.col("component_id").eqNullSafe(F.col("doc_id")))
            .select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("_stays")).distinct())
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      order_id(id_col).alias("_stays"))
    return (row.join(stay, "_stays", "left_semi")
            .select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
