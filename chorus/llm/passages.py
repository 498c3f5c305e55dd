"""Substring de-duplication by FM-indexes over shards of passages (operator 2).

A word goes if a window of ``WINDOW`` words covers it whose word sequence also
starts in a document with a smaller id. Streaming every document past the index of
every shard would cost documents times shards; here documents meet only the shards
that can hold a match:

1. anchors: the ``GRAM``-word sequences with the least hash of some window. Equal
   windows have equal anchors, so a match lies inside the passages around a shared
   anchor: ``WINDOW - GRAM`` words to either side;
2. equal texts, and then equal passages, collapse to one with its smallest id.
   Anchors of a single document go, and those with one passage need no search;
3. an anchor with more than ``HOT`` different passages is replaced by longer ones about its
   place, each with a part of the windows and a narrower passage, and those that are still
   hot again. Most narrower passages are of one document only and go, so the passages of
   an anchor in a third of all documents spread over all shards;
4. each shard builds a compressed FM-index of its passages: suffix order, the
   Burrows-Wheeler transform in a wavelet matrix with packed bits and block ranks,
   and one bit per suffix that starts a new group of equal windows. Every passage
   is streamed backwards through the index. A step narrows the interval of the
   suffix; the group bit widens it to all suffixes that share ``WINDOW`` words, the
   matching statistics cut at the threshold. The smallest id of the group decides;
5. intervals go back to the documents whose passages they are. Passages that hold a large
   share of all places are few and broadcast, so no key of that join is large.

Windows are judged on the input. Defined results: a null text has no words and an
empty kept text; a missing id counts as larger than any other; rows with equal id
and text are one document, rows with equal id and other text are compared as equals,
since no id is smaller; an empty table gives an empty result. Columns other than
id and text are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chorus.llm.common import marked, maybe, order_id, stage, tuples, utf8

WINDOW = 50
GRAM = 8
HOT = 512
SHARD_WORDS = 150_000
LEAST_SHARDS = 64
CROWDED = 1024
#: Narrower passages that one of a hot anchor is cut into.
WAYS = 4
#: Length of the span of a text that goes whole, if it has a window.
ALL = (1 << 31) - 1

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LETTERS = _mixed(np.arange(1, 257, dtype=np.uint64))
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number, as many as the longest word seen so far has bytes."""
    if len(_POWERS[0]) < n:
        grown = np.full(1 << (n - 1).bit_length(), 0x100000001B3 * 2 + 1, np.uint64)
        grown[0] = 1
        _POWERS[0] = np.cumprod(grown, dtype=np.uint64)
    return _POWERS[0]


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text and the bytes they start at, from its bytes alone."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.r_[False, ~_WHITE[raw], False]
    start = np.flatnonzero(inside[1:] & ~inside[:-1])
    if not len(start):
        return np.zeros(0, np.uint64), start
    length = np.flatnonzero(inside[:-1] & ~inside[1:]) - start
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    letters = _LETTERS[raw[inside[1:-1]]]
    sums = np.add.reduceat(letters * _powers(int(length.max()))[place], first)
    return _mixed(_mixed(sums) + length.astype(np.uint64) * _MIX), start


def bundles(texts: list[bytes], most: int = 1 << 18):
    """Ranges of neighbouring texts of about ``most`` bytes; a longer text is a range of its own."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def runs(h: np.ndarray, most: int, seed: int = 0) -> list[np.ndarray]:
    """Hashes of all runs of 1, 2, 4, ... words, up to ``most``."""
    out, width = [_mixed(h + np.uint64(seed))], 1
    while 2 * width <= most:
        last = out[-1]
        out.append(_mixed(last[:max(0, len(last) - width)] * _MIX + last[width:] + np.uint64(width)))
        width *= 2
    return out


def spans_hash(levels: list[np.ndarray], start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of runs of any length, each from the two powers of two that cover it."""
    out = np.zeros(len(start), np.uint64)
    level = np.frexp(length.astype(np.float64))[1] - 1
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        first, last = start[at], start[at] + length[at] - (1 << k)
        out[at] = _mixed(levels[k][first] * _MIX + levels[k][last] + length[at].astype(np.uint64))
    return out


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    pick = np.minimum if least else np.maximum
    size = 1
    while size < width:
        step = min(size, width - size)
        x = pick(x[:len(x) - step], x[step:])
        size += step
    return x


def anchors(h: np.ndarray, edges: np.ndarray, window: int = WINDOW,
            gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the least of some window.

    ``edges`` are the words at which texts begin, and the end of the last: a window lies
    in one text.
    """
    n = max(0, len(h) - gram + 1)
    grams = spans_hash(runs(h, gram, 1), np.arange(n), np.full(n, gram))
    per_window = window - gram + 1
    if len(h) < window:
        return np.zeros(0, np.int64), grams[:0]
    least = _sliding(grams, per_window, True)
    across = np.zeros(len(least) + 1, np.int64)
    inner = edges[1:-1]
    np.add.at(across, np.clip(inner - window + 1, 0, len(least)), 1)
    np.add.at(across, np.minimum(inner, len(least)), -1)
    least[np.cumsum(across[:-1]) > 0] = 0
    fill = np.zeros(per_window - 1, np.uint64)
    most = _sliding(np.concatenate([fill, least, fill]), per_window, False)
    at = np.flatnonzero(most == grams)
    return at, grams[at]


def _placed(p: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Hashes of passages and of the place of the gram in them."""
    return _mixed(p + gram.astype(np.uint64) * _MIX)


def _passages(window: int, gram: int):
    """Passages around the anchors of each text: hashes and places, no words.

    Short texts are taken many at a time, so that array steps are not paid for each.
    """
    def run(batch, _):
        out: dict[str, list] = {f.split()[0]: [] for f in _MEMBER.split(", ")}
        ids, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        texts = [t or b"" for t in batch.column(2).to_pylist()]
        for a, z in bundles(texts):
            h, byte = words_of(b" ".join(texts[a:z]))
            sizes = np.array([len(t) + 1 for t in texts[a:z]])
            edges = np.searchsorted(byte, np.r_[0, np.cumsum(sizes)])
            at, value = anchors(h, edges, window, gram)
            if not len(at):
                continue
            text = np.searchsorted(edges, at, side="right") - 1
            start = np.maximum(at - (window - gram), edges[text])
            length = np.minimum(at + window, edges[text + 1]) - start
            p = _placed(spans_hash(runs(h, int(length.max())), start, length), at - start)
            for k, x in zip(out, (ids[a + text], own[a + text], value.view(np.int64),
                                  p.view(np.int64), start - edges[text], length, at - start,
                                  np.full(len(at), gram))):
                out[k].append(x)
        return {k: np.concatenate(x) for k, x in out.items()} if out["doc"] else None
    return run


class Wavelet:
    """Wavelet matrix: per bit of the symbols one packed bit row with block ranks."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.n, self.levels = len(symbols), max(1, int(n_symbols - 1).bit_length())
        self.words, self.ranks, self.zeros = [], [], []
        every, base = np.arange(n_symbols), np.zeros(n_symbols, np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, bool)
            padded[:self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.ranks.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]
                              .astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            # Where the run of each symbol begins, one level further down.
            ones = self._ones(-1, base)
            base = np.where((every >> level) & 1, self.zeros[-1] + ones, base - ones)
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.base = base

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[level][block] + np.bitwise_count(self.words[level][block] & below)

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Occurrences of symbols before ``low`` and before ``high``."""
        for row, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, z = self._ones(row, low), self._ones(row, high)
            low = np.where(one, self.zeros[row] + a, low - a)
            high = np.where(one, self.zeros[row] + z, high - z)
        return low - self.base[symbol], high - self.base[symbol]


class FMIndex:
    """Index of passages of words, for windows of a fixed number of words."""

    def __init__(self, passages: list[list], owners: np.ndarray, window: int = WINDOW):
        self.window, self.n_passages = window, len(passages)
        code: dict = {}
        sizes = np.array([len(p) for p in passages], np.int64)
        self.words = np.fromiter((code.setdefault(w, len(code)) for p in passages for w in p),
                                 np.int64, int(sizes.sum())) + len(passages)
        self.n_symbols = len(passages) + len(code)
        # Every passage ends in a sign of its own, smaller than all words.
        self.ends = np.cumsum(sizes + 1)
        n = int(self.ends[-1])
        text = np.empty(n, np.int64)
        sign = np.zeros(n, bool)
        sign[self.ends - 1] = True
        text[sign], text[~sign] = np.arange(len(passages)), self.words
        self.starts = self.ends - sizes - 1
        rank, order, at_window = self._sort(text)
        before = np.where(order == 0, text[-1], text[order - 1])
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=self.n_symbols))]
        self.wavelet = Wavelet(before, self.n_symbols)
        # Groups of suffixes that share a whole window.
        new = np.r_[True, at_window[order][1:] != at_window[order][:-1]]
        whole = (self.ends - 1)[np.searchsorted(self.ends, order, side="right")] - order >= window
        self.group = np.cumsum(new) - 1
        owner = owners[np.searchsorted(self.ends, order, side="right")]
        self.group_owner = np.minimum.reduceat(owner, np.flatnonzero(new))
        self.group_whole = np.logical_and.reduceat(whole, np.flatnonzero(new))
        self.text = text

    def _sort(self, text: np.ndarray):
        """Suffix order by doubling; classes of suffixes by their first ``window`` words."""
        n, size = len(text), 1
        rank = text
        pieces: list[tuple[int, np.ndarray]] = [(1, text)]
        while True:
            follow = np.zeros(n, np.int64)
            follow[:n - size] = rank[size:] + 1
            key = rank * (int(rank.max()) + 2) + follow
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
            size *= 2
            pieces.append((size, rank))
            if rank[order[-1]] == n - 1 or size >= n:
                break
        covered, classes = 0, None
        for width, part in reversed(pieces):
            while covered + width <= self.window:
                shifted = np.full(n, -1, np.int64)
                shifted[:n - covered] = part[covered:]
                if classes is None:
                    classes = shifted
                else:
                    _, classes = np.unique(classes * (n + self.n_symbols + 2) + shifted + 1,
                                           return_inverse=True)
                covered += width
        return rank, order, classes

    def matches(self):
        """(passage, place, owner) of every whole window of the indexed passages.

        All passages are searched backwards side by side, one word a step.
        """
        sizes = self.ends - self.starts - 1
        low = np.zeros(self.n_passages, np.int64)
        high = np.full(self.n_passages, len(self.text), np.int64)
        found = []
        for step in range(1, int(sizes.max(initial=0)) + 1):
            live = np.flatnonzero(sizes >= step)
            place = self.ends[live] - 1 - step
            word = self.text[place]
            a, b = self.wavelet.rank(word, low[live], high[live])
            low[live], high[live] = self.first[word] + a, self.first[word] + b
            if step >= self.window:
                group = self.group[low[live]]
                fine = self.group_whole[group] & (high[live] > low[live])
                found.append((live[fine], (place - self.starts[live])[fine],
                              self.group_owner[group[fine]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


def _runs(passage: np.ndarray, place: np.ndarray):
    """Runs of neighbouring places: passage, first place, number of places."""
    if not len(passage):
        return passage, place, place
    order = np.lexsort((place, passage))
    passage, place = passage[order], place[order]
    cut = np.r_[True, (passage[1:] != passage[:-1]) | (place[1:] != place[:-1] + 1)]
    at = np.flatnonzero(cut)
    return passage[at], place[at], np.diff(np.r_[at, len(place)])


def _search_shard(window: int):
    def run(table: pa.Table) -> pa.Table:
        # Rows with equal id and text hold the same passages.
        table = table.group_by(["anchor", "p"]).aggregate([("least", "min"), ("words", "min")])
        table = table.sort_by([("anchor", "ascending"), ("p", "ascending")])
        least = table["least_min"].to_numpy()
        index = FMIndex([t.split() for t in table["words_min"].to_pylist()], least, window)
        passage, place, owner = index.matches()
        earlier = owner < least[passage]
        passage, place, n = _runs(passage[earlier], place[earlier])
        return pa.table({"anchor": pa.array(table["anchor"].to_numpy()[passage], pa.int64()),
                         "p": pa.array(table["p"].to_numpy()[passage], pa.int64()),
                         "place": pa.array(place, pa.int32()),
                         "words": pa.array(n + window - 1, pa.int32())})
    return run


def narrower(place: np.ndarray, size: np.ndarray, n: int, window: int) -> np.ndarray:
    """Longer grams and smaller passages for grams of ``size`` words at ``place`` of ``n``.

    The windows that hold a gram start in ``[place + size - window, place]``. This range is cut
    into ``WAYS``; the windows of each share the words from its last start to the end of its
    first window. Gives rows of gram, its size, start and length of the passage around it.
    """
    low, count = place + size - window, window - size + 1
    found = []
    for k in range(WAYS):
        first, last = low + k * count // WAYS, low + (k + 1) * count // WAYS - 1
        a, z = np.maximum(first, 0), np.minimum(last, n - window)
        found.append(np.stack([last, first + window - last, a, z + window - a], 1)
                     [(first <= last) & (a <= z)])
    return np.unique(np.concatenate(found), axis=0)


def _split(window: int):
    """The narrower passages of hot anchors, from the texts and the places of their grams."""
    def run(batch, _):
        out: dict[str, list] = {f.split()[0]: [] for f in _MEMBER.split(", ")}
        for doc, version, text, at in zip(*(c.to_pylist() for c in batch.columns)):
            h, _ = words_of(text)
            place, size, start, length = narrower(
                np.array([x["start"] + x["gram"] for x in at]), np.array([x["size"] for x in at]),
                len(h), window).T
            long = size.astype(np.uint64) * _MIX
            anchor = _mixed(spans_hash(runs(h, window, 11), place, size) + long)
            p = _placed(spans_hash(runs(h, 2 * window, 13), start, length) + long, place - start)
            for k, x in zip(out, (np.full(len(place), doc), np.full(len(place), version),
                                  anchor.view(np.int64), p.view(np.int64), start, length,
                                  place - start, size)):
                out[k].append(x)
        return {k: np.concatenate(x) for k, x in out.items()} if out["doc"] else None
    return run


#: A passage of a document, with place and size of the gram that is its anchor.
_MEMBER = ("doc long, version long, anchor long, p long, start int, length int, gram int, "
           "size int")


def _uneven_join(rows: DataFrame, lookup: DataFrame, keys: list[str], times: str) -> DataFrame:
    """Inner join with a lookup whose keys have ``times`` rows each.

    Keys of over ``1 / CROWDED`` of the rows, fewer than ``CROWDED`` and hence broadcast, leave
    the join of the others without a large key.
    """
    most = rows.count() / CROWDED
    marked = rows.join(F.broadcast(lookup.filter(F.col(times) > most)), keys, "left")
    rest = marked.filter(F.col(times).isNull()).select(rows.columns)
    return marked.filter(F.col(times).isNotNull()).unionByName(
        rest.join(lookup.filter(F.col(times) <= most), keys))


def _shared_passages(members: DataFrame) -> DataFrame:
    """(anchor, p, least, place, times, n) of distinct passages whose anchor has several documents."""
    distinct = stage(members.groupBy("anchor", "p").agg(
        F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("times"),
        F.min(F.struct("doc", "version", "start", "length")).alias("place")), "passages-distinct")
    several = stage(distinct.groupBy("anchor").agg(F.min("least").alias("a"), F.max("most").alias("z"),
                                                   F.count("*").alias("n"))
                    .filter("a < z").select("anchor", "n"), "passages-anchors")
    return stage(_uneven_join(distinct.drop("most"), several, ["anchor"], "n"), "passages-shared")


def _cut_out(batch, _):
    """The words of passages, from the texts they first occur in."""
    out: dict[str, list] = {k: [] for k in ("anchor", "p", "least", "words")}
    for text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        words = text.split()
        for x in at:
            for k in ("anchor", "p", "least"):
                out[k].append(x[k])
            out["words"].append(b" ".join(words[x["start"]:x["start"] + x["length"]]))
    return out


def _with_texts(rows: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """doc, version, t and the rows ``at`` of each document that has any."""
    per_doc = stage(rows.groupBy("doc", "version").agg(
        F.collect_list(F.struct(*columns)).alias("at")), "passages-per-doc")
    some = maybe(docs, F.col("doc"), per_doc.select("doc"))
    return some.join(per_doc, ["doc", "version"])


def _later_copies(docs: DataFrame) -> DataFrame:
    """(doc, version) of the rows whose whole text a document with a smaller id has."""
    ids = stage(docs.select("doc", "version", F.xxhash64(F.lit(1), "t").alias("again")), "passages-ids")
    first = (ids.groupBy("version", "again").agg(F.min("doc").alias("a"), F.max("doc").alias("z"))
             .filter("a < z").select("version", "again", "a"))
    return stage(ids.join(first, ["version", "again"]).filter("doc > a")
                 .select("doc", "version").distinct(), "passages-copies")


def _verdicts(shared: DataFrame, found: DataFrame) -> DataFrame:
    """anchor, p, least, times and the hits of distinct passages."""
    return shared.select("anchor", "p", "least", "times").join(
        found.groupBy("anchor", "p").agg(F.collect_list(F.struct("place", "words")).alias("hits")),
        ["anchor", "p"], "left")


def _hits(members: DataFrame, verdicts: DataFrame, window: int) -> DataFrame:
    """doc, version, start and a ``hit`` (place, words) in the passage there, one a row.

    A passage that equals one of a smaller document goes whole, the first one loses its hits.
    """
    whole = F.array(F.struct(F.lit(0).alias("place"), F.col("length").alias("words")))
    hits = (F.when((F.col("doc") > F.col("least")) & (F.col("length") >= window), whole)
            .when(F.col("doc") == F.col("least"), F.col("hits")))
    return (_uneven_join(members, verdicts, ["anchor", "p"], "times")
            .select("doc", "version", "start", F.explode(hits).alias("hit")))


def _narrowed(members: DataFrame, shared: DataFrame, docs: DataFrame, window: int, hot: int):
    """Members and shared passages with those of the narrower passages of hot anchors.

    Only the first document of a passage is cut up, as the others lose it whole. Rounds go on
    while an anchor is hot; one as long as a window has one passage.
    """
    members_of, shared_of = [members], [shared]
    while True:
        busy = shared_of[-1].filter(F.col("n") > hot).select("anchor", "p", F.col("least").alias("doc"))
        if busy.isEmpty():
            return (reduce(DataFrame.unionByName, frames) for frames in (members_of, shared_of))
        own = members_of[-1].join(busy, ["anchor", "p", "doc"], "left_semi")
        texts = _with_texts(own, docs, "start", "gram", "size").select("doc", "version", "t", "at")
        members_of.append(stage(tuples(texts, _split(window), _MEMBER), "passages-narrower"))
        shared_of.append(_shared_passages(members_of[-1]))


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  hot: int = HOT) -> DataFrame:
    """(doc, version, spans) of the documents that lose words; docs has doc, version and t."""
    copies = _later_copies(docs)
    looked = marked(docs, F.col("doc"), copies.select("doc"))
    # Of equal texts the first decides for the others, which need no search.
    firsts = looked.filter(~F.col("_maybe")).drop("_maybe").unionByName(
        looked.filter("_maybe").drop("_maybe").join(copies, ["doc", "version"], "left_anti"))
    every = stage(tuples(firsts, _passages(window, gram), _MEMBER), "passages")
    several = every.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).filter("a < z")
    members = stage(maybe(every, F.col("anchor"), several.select("anchor")), "passages-members")
    members, shared = _narrowed(members, _shared_passages(members), docs, window, hot)
    # The windows of an anchor's only passage equal nothing but that passage.
    search = shared.filter((F.col("n") > 1) & (F.col("n") <= hot))
    reps = search.select("place.*", "anchor", "p", "least")
    texts = _with_texts(reps, docs, "anchor", "p", "least", "start", "length").select("t", "at")
    cut = tuples(texts, _cut_out, "anchor long, p long, least long, words binary")
    shards = max(LEAST_SHARDS, -(-search.count() * (2 * window - gram) // SHARD_WORDS))
    found = stage(cut.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
                  .groupBy("shard").applyInArrow(
                      _search_shard(window), "anchor long, p long, place int, words int"),
                  "passages-found")
    verdicts = stage(_verdicts(shared, found), "passages-verdicts")
    spans = (_hits(members, verdicts, window)
             .select("doc", "version", F.struct(
                 (F.col("start") + F.col("hit.place")).alias("start"),
                 F.col("hit.words").alias("length")).alias("span"))
             .groupBy("doc", "version").agg(F.collect_set("span").alias("spans")))
    return spans.unionByName(copies.select("doc", "version", F.array(F.struct(
        F.lit(0).alias("start"), F.lit(ALL).alias("length"))).alias("spans")))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, gram: int = GRAM, hot: int = HOT,
                   with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text of every row."""
    texts = docs.select(order_id(id_col).alias("doc"), F.xxhash64(text_col).alias("version"),
                        utf8(text_col).alias("t"))
    spans = stage(removed_spans(texts, window, gram, hot), "passages-removed")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), order_id(id_col).alias("doc"),
                       F.xxhash64(text_col).alias("version"), utf8(text_col).alias("t"))
    # Documents that lose nothing need not move.
    looked = marked(rows, F.col("doc"), spans.select("doc"))
    joined = (looked.filter("_maybe").join(spans, ["doc", "version"], "left").select("doc_id", "t", "spans")
              .unionByName(looked.filter(~F.col("_maybe")).select(
                  "doc_id", "t", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))))

    def run(batch, _):
        sizes, removed, digests, kept_texts = [], [], [], []
        for text, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = (text or b"").split()
            if at and len(words) >= window:
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, [x["start"] for x in at], 1)
                np.add.at(change, [min(x["start"] + x["length"], len(words)) for x in at], -1)
                stays = np.cumsum(change[:-1]) == 0
                kept = [words[i] for i in np.flatnonzero(stays).tolist()]
            else:
                kept = words
            joined_text = b" ".join(kept)
            sizes.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(joined_text).hexdigest())
            if with_text:
                kept_texts.append(joined_text.decode())
        return {"doc_id": batch.column(0), "n_words": sizes, "n_removed": removed,
                "kept_sha256": digests, "kept_text": kept_texts}

    return tuples(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string"
                  + ", kept_text string" * with_text)
