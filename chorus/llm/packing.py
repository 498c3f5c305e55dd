"""Best-fit packing by hierarchical residual packing (operator 10).

Every document becomes the ids of the tokenizer and an end id. Longer documents
are cut into pieces of ``capacity``; the first piece takes the remainder. Full
pieces are sequences of their own. The others are items:

1. each task packs its items best-fit, largest first, into bins;
2. bins with less room than the least filled of all bins uses are as full as they can
   get and are emitted, the underfull ones become items;
3. rounds deal the underfull bins to fewer groups and pack them again, until one
   group holds the rest, where no two bins fit together any more.

A group holds ``GROUP`` bins with ``MEMBERS`` pieces on average, so no task grows with the corpus. Where that
takes several groups, rounds deal the bins anew to as many, and end when ``STILL`` of
them in a row merge nothing. A bin carries its members and their offsets, so nothing
has to be joined afterwards.

Texts of Latin characters are encoded by a byte-pair encoder made from the tokenizer
file's own vocabulary; everything else, special strings too, by the library. A text
that holds both is cut before a space that a plain character follows, where the
pattern of the vocabulary always cuts. The tests hold the ids against the library on
whole texts.

Defined results: a null text is empty; an empty text is one piece with the end id
alone; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chorus.llm.common import stage
from chorus.llm.tokens import tokenizer

CAPACITY = 1024
END_ID = 2
GROUP = 40_000  # bins
MEMBERS = 400_000  # pieces in the bins of a group
STILL = 3  # rounds in a row without a merge that end the work
FLUSH = 100_000

MEMBER = ("struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,"
          "offset:bigint>")
BIN = f"bin long, used int, members array<{MEMBER}>"
ARROW_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                          ("length", pa.int64()), ("ids_crc32", pa.int64()),
                          ("offset", pa.int64())])


def _byte_letters() -> dict[int, str]:
    """The printable letter a byte-level vocabulary writes for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


# Fixed value: the pre-token pattern of byte-level vocabularies.
_PRE_TOKENS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Characters whose classes no Unicode version disputes; others go through the library.
_LATIN = re.compile("[\\t\\n -~\u00c0-\u024f]*").fullmatch

#: A space starts a token where one of these characters follows.
_CUT = re.compile(" (?=[!-~À-ᙿ])")


class Encoder:
    """Ids of whole texts as the library gives them."""

    def __init__(self, path: str):
        import json

        import tiktoken

        self.library = tokenizer(path)
        letters = {letter: byte for byte, letter in _byte_letters().items()}
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        special = {t["content"] for t in content["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, special)) if special else "(?!)")
        ranks = {bytes(letters[c] for c in piece): i
                 for piece, i in content["model"]["vocab"].items() if piece not in special}
        self.fast = tiktoken.Encoding("texts", pat_str=_PRE_TOKENS, mergeable_ranks=ranks,
                                      special_tokens={})

    def __call__(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        if self._common(text):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        out, before = [], ""
        for common, chunks in groupby(_CUT.split(text), self._common):
            part = before + " ".join(chunks)
            ids = (self.fast.encode_ordinary(part) if common
                   else self.library.encode(part, add_special_tokens=False).ids)
            out.append(array("I", ids).tobytes())
            before = " "
        return b"".join(out)

    def _common(self, text: str) -> bool:
        return _LATIN(text) is not None and not self.special.search(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder for a tokenizer file, made once per worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; the remainder comes first."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    cuts = [0, *range(first, n + 1, capacity)]
    raw = memoryview(ids)
    return [(i, a, b - a, zlib.crc32(raw[4 * a:4 * b])) for i, (a, b) in
            enumerate(zip(cuts[:-1], cuts[1:]))]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest item first, into the fullest bin that has room."""
    open_rooms: list[int] = []  # distinct rooms in use, sorted
    by_room: dict[int, list[list[int]]] = {}
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[i]
        at = bisect_left(open_rooms, size)
        if at == len(open_rooms):
            chosen, room = [], capacity
            bins.append(chosen)
        else:
            room = open_rooms[at]
            chosen = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], open_rooms[at]
        chosen.append(i)
        room -= size
        if room:
            if room not in by_room:
                insort(open_rooms, room)
                by_room[room] = []
            by_room[room].append(chosen)
    return bins


def _merged(items: list[tuple[int, list]], capacity: int):
    """Best-fit over bins as items: (used, members with moved offsets) of the new bins."""
    for chosen in best_fit([used for used, _ in items], capacity):
        members, used = [], 0
        for i in chosen:
            for m in items[i][1]:
                members.append({**m, "offset": m["offset"] + used})
            used += items[i][0]
        yield used, members


def _batch(bins, prefix: int) -> pa.RecordBatch:
    used, members = zip(*bins)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(used)) + prefix, pa.int64()), pa.array(used, pa.int32()),
         pa.array(members, pa.list_(ARROW_MEMBER))], names=["bin", "used", "members"])


def local_bins(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Round 0: tokenise, cut and pack the documents of each task."""
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 36
        encode, items, made = encoder(tokenizer_path), [], 0
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, full = batch.slice(at, 256), []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    for piece, start, length, crc in pieces(encode(text) + end, capacity):
                        member = {"doc_id": doc, "piece": piece, "start": start, "length": length,
                                  "ids_crc32": crc, "offset": 0}
                        (full if length == capacity else items).append((length, [member]))
                if full:
                    yield _batch(full, part + made)
                    made += len(full)
                if len(items) >= FLUSH:
                    yield _batch(bins := list(_merged(items, capacity)), part + made)
                    items, made = [], made + len(bins)
        if items:
            yield _batch(list(_merged(items, capacity)), part + made)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("t")).mapInArrow(run, BIN)


def _repack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["g"]).sort_by("bin")
        items = list(zip(table["used"].to_pylist(), table["members"].to_pylist()))
        numbers = table["bin"].to_pylist()  # a new bin takes the number of one of its own
        bins = list(_merged(items, capacity))
        batch = _batch(bins, 0)
        return pa.Table.from_batches([batch]).set_column(
            0, "bin", pa.array(numbers[:len(bins)], pa.int64()))
    return run


def _parted(bins: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Underfull bins, bins that no other fits into, and the bins and members of the first."""
    uses = bins.groupBy("used").agg(F.count("*"), F.sum(F.size("members"))).collect()
    most = capacity - min((used for used, _, _ in uses), default=0)
    rest = [(n, members) for used, n, members in uses if used <= most]
    return (bins.filter(F.col("used") <= most), bins.filter(F.col("used") > most),
            sum(n for n, _ in rest), sum(members for _, members in rest))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
         id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8,
         group: int = GROUP, most_members: int = MEMBERS) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    rest = stage(local_bins(docs, tokenizer_path, capacity, id_col, text_col), "packing-0")
    tasks = max(1, docs.sparkSession.sparkContext.defaultParallelism)
    done, level, still, before = [], 0, 0, None
    while True:
        rest, full, left, members = _parted(rest, capacity)
        done.append(full)
        if left <= 1:
            break
        least = max(-(-left // group), -(-members // most_members))
        groups = max(least, tasks // fan_in ** level, 1)
        still = still + 1 if before == (left, groups) else 0
        if still == STILL:
            break
        before, level = (left, groups), level + 1
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)))
        rest = stage(dealt.groupBy("g").applyInArrow(_repack(capacity), BIN), f"packing-{level}")
        if groups == 1:
            break
    done.append(rest)
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select(
        "m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
