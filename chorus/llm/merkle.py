"""Merkle manifest of a table as a persistent, path-copying tree (operator 11).

Every row is a leaf, the SHA-256 of its length-prefixed fields. The leaves of a group
(a source) ascend by id; runs of ``ARITY`` nodes become their digest until one is left,
the root of the group; the group roots, in the order of the groups, likewise give the
root of the table.

The tree is cut into aligned blocks of ``ARITY ** LEVELS`` nodes, each one row of a
staged table. Blocks climb ``LEVELS`` levels on their own; their tops are the nodes of
the next round, whose blocks are again rows, so that a group of any size is spread over
many tasks and the number of rounds is a logarithm of the rows. Then the siblings above
each block are handed down, one row per block.

A changed leaf makes a version of the tree. It shares every untouched node and copies
only the ancestors of the leaf: first those inside the block, then the ones above from
the siblings handed down, without meeting other versions. The copies of a version,
from its leaf to its root, are the column ``copies``.

Defined results: a null field is encoded as ``-``, an empty one as ``0:``; texts are
hashed whole. A missing id comes last in its group and is never changed by a test on the
id; rows of equal id follow the order of their digests, and equal rows are leaves of
their own. A missing group is the first group. A group of one leaf has that leaf as its
root, a table of one group the root of that group. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chorus.llm.common import order_id, stage, tuples
from chorus.operators.ordering import prefix_sums

ARITY = 16
LEVELS = 2
BLOCK = ARITY ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left: binary, right: binary>>"
_AT_ONCE = 16  # blocks that a task holds as Python objects


def encoded(field: Column) -> Column:
    """A field as its UTF-8 length, a colon and its value; ``-`` if it is null."""
    value = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(f) for f in fields]), 256))


def joined(nodes: Sequence[bytes]) -> bytes:
    """The digest of a run of nodes, which are concatenated as lower-case hex text."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def climb(digests: Sequence[bytes], n: int) -> list[list[bytes]]:
    """The levels of a block of a level with ``n`` nodes in the whole tree.

    The block of a larger tree climbs all ``LEVELS``, even with a single node; the only
    block of a tree ends at its root.
    """
    levels = [list(digests)]
    while n > 1 and len(levels) <= LEVELS:
        last = levels[-1]
        levels.append([joined(last[i:i + ARITY]) for i in range(0, len(last), ARITY)])
        n = -(-n // ARITY)
    return levels


def siblings(levels: Sequence[Sequence[bytes]], at: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of the node ``at`` and of its ancestors in a block."""
    path = []
    for level in levels[:-1]:
        first = at - at % ARITY
        path.append((b"".join(level[first:at]), b"".join(level[at + 1:first + ARITY])))
        at //= ARITY
    return path


def copied(leaf: bytes, path: Sequence[tuple[bytes, bytes]]) -> list[bytes]:
    """The nodes of a version: its leaf and a copy of every ancestor, the root last."""
    nodes = [leaf]
    for left, right in path:
        nodes.append(joined((left, nodes[-1], right)))
    return nodes


def _steps(path: list[dict]) -> list[tuple[bytes, bytes]]:
    return [(p["left"], p["right"]) for p in path]


def _blocks(nodes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Nodes (tree, pos, n, digest) as rows of whole blocks; ``keep`` become arrays too."""
    row = F.struct("pos", "digest", *keep)
    gathered = (nodes.groupBy("tree", F.expr(f"pos div {BLOCK}").alias("block"))
                .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(row)).alias("rows")))
    return gathered.select("tree", "block", "n", F.col("rows.digest").alias("digests"),
                           *[F.col(f"rows.{c}").alias(c) for c in keep])


def _tops(blocks: DataFrame) -> DataFrame:
    """The top of every block as a node of the next round."""
    def top(batch: pa.RecordBatch, _):
        rows = batch.to_pydict()
        return {"tree": rows["tree"], "pos": rows["block"],
                "n": [-(-n // BLOCK) for n in rows["n"]],
                "digest": [climb(d, n)[-1][0] for d, n in zip(rows["digests"], rows["n"])]}

    return tuples(blocks.select("tree", "block", "n", "digests"), top,
                  "tree string, pos long, n long, digest binary", rows=_AT_ONCE)


def build(leaf_blocks: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, the leaves first, and (tree, digest) of the roots."""
    rounds, roots = [leaf_blocks], None
    while True:
        tops = stage(_tops(rounds[-1]), "merkle-tops")
        done = tops.filter(F.col("n") == 1).select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        rest = tops.filter(F.col("n") > 1)
        if rest.isEmpty():
            return rounds, roots
        rounds.append(stage(_blocks(rest), "merkle-blocks"))


def hand_down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, block, path, subroot) of the blocks of the first round.

    ``above`` has for every tree the path above its root and what goes with it, here the
    column ``subroot``.
    """
    def children(batch: pa.RecordBatch, _):
        out: dict[str, list] = {"tree": [], "block": [], "path": [], "subroot": []}
        for r in batch.to_pylist():
            levels, over = climb(r["digests"], r["n"]), r["path"]
            for at in range(len(r["digests"])):
                out["tree"].append(r["tree"])
                out["block"].append(r["block"] * BLOCK + at)
                out["path"].append([{"left": a, "right": b} for a, b in siblings(levels, at)] + over)
                out["subroot"].append(r["subroot"])
        return out

    paths = None
    for blocks in reversed(rounds):
        own = (blocks.filter(F.col("n") <= BLOCK).select("tree", "block")
               .join(above, "tree").select("tree", "block", "path", "subroot"))
        paths = own if paths is None else own.unionByName(paths)
        if blocks is not rounds[0]:
            paths = stage(tuples(blocks.join(paths, ["tree", "block"]), children,
                                 f"tree string, block long, path {_PATH}, subroot binary",
                                 rows=_AT_ONCE), "merkle-paths")
    return paths


def _group_paths(roots: DataFrame) -> tuple[DataFrame, bytes | None]:
    """(tree, path, subroot) of every group in the tree of the groups, and its root."""
    ranked = prefix_sums(roots.withColumn("one", F.lit(1)), [], ["tree"], ["one"])
    groups = stage(ranked.select(F.col("tree").alias("group"), F.col("before_one").alias("pos"),
                                 F.col("total_one").alias("n"), "digest"), "merkle-groups")
    blocks = stage(_blocks(groups.withColumn("tree", F.lit(""))), "merkle-blocks")
    rounds, top = build(blocks)
    root = top.first()
    start = roots.sparkSession.createDataFrame([("", [], b"")], f"tree string, path {_PATH}, subroot binary")
    upper = hand_down(rounds, start)

    def per_group(batch: pa.RecordBatch, _):
        out: dict[str, list] = {"pos": [], "path": [], "subroot": []}
        for r in batch.to_pylist():
            levels = climb(r["digests"], r["n"])
            for at, digest in enumerate(r["digests"]):
                out["pos"].append(r["block"] * BLOCK + at)
                out["path"].append([{"left": a, "right": b} for a, b in siblings(levels, at)]
                                   + r["path"])
                out["subroot"].append(digest)
        return out

    placed = tuples(rounds[0].join(upper, ["tree", "block"]), per_group,
                    f"pos long, path {_PATH}, subroot binary", rows=_AT_ONCE)
    paths = placed.join(groups.select("pos", F.col("group").alias("tree")), "pos")
    return stage(paths.select("tree", "path", "subroot"), "merkle-paths"), root and root["digest"]


def manifest(rows: DataFrame, where: Column, changes: Mapping[str, Column],
             fields: Sequence[str] = FIELDS, id_col: str = "doc_id",
             group_col: str = "source") -> DataFrame:
    """One row per row: its leaf, proof and roots, and the version its change makes.

    Rows for which ``where`` holds are read again with ``changes`` (field to new value).
    ``proof_sha256`` is the digest of all siblings from the leaf to the root;
    ``folded_root`` is the root that leaf (the changed one, if there is one) and siblings
    give, ``copies`` the digests of the nodes a changed leaf copied, bottom to top.
    """
    changed = [changes.get(f, F.col(f)) for f in fields]
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = rows.select(
        tree.alias("tree"), order_id(id_col).alias("key"), F.col(id_col).cast("long").alias("id"),
        leaf_digest([F.col(f) for f in fields]).alias("digest"),
        F.when(F.coalesce(where, F.lit(False)), leaf_digest(changed)).alias("changed"),
        F.lit(1).alias("one"))
    ranked = prefix_sums(stage(leaves, "merkle-leaves"), ["tree"], ["key", "digest"], ["one"])
    nodes = ranked.select("tree", F.col("before_one").cast("long").alias("pos"),
                          F.col("total_one").cast("long").alias("n"), "digest", "id", "changed")
    blocks = stage(_blocks(nodes, ["id", "changed"]), "merkle-blocks")
    rounds, roots = build(blocks)
    above, root = _group_paths(roots)

    def leaf_rows(batch: pa.RecordBatch, _):
        out: dict[str, list] = {c: [] for c in ("id", "leaf", "subroot", "proof_sha256",
                                                "folded_root", "copies")}
        for r in batch.to_pylist():
            levels, over = climb(r["digests"], r["n"]), _steps(r["path"])
            subroot = r["subroot"].hex()
            for at, (leaf, new) in enumerate(zip(r["digests"], r["changed"])):
                path = siblings(levels, at) + over
                version = copied(leaf if new is None else new, path)
                out["id"].append(r["id"][at])
                out["leaf"].append(leaf.hex())
                out["subroot"].append(subroot)
                out["proof_sha256"].append(joined([s for p in path for s in p]).hex())
                out["folded_root"].append(version[-1].hex())
                out["copies"].append(None if new is None else [v.hex() for v in version])
        return out

    found = tuples(blocks.join(hand_down(rounds, above), ["tree", "block"]), leaf_rows,
                   "id long, leaf string, subroot string, proof_sha256 string, "
                   "folded_root string, copies array<string>", rows=_AT_ONCE)
    root_hex = F.lit(root.hex() if root else None).cast("string")
    return found.select(
        F.col("id").alias(id_col), "leaf", "subroot", root_hex.alias("root"), "proof_sha256",
        "folded_root", (F.col("folded_root") == root_hex).alias("verified"), "copies")


def lower_ascii(column: str) -> Column:
    """The text with A to Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.col(column), upper, upper.lower())


def one_in(every: int, id_col: str = "doc_id") -> Column:
    """Rows whose id, as decimal text, has a CRC-32 that ``every`` divides."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
