from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from chorus.llm import packing

FILE = str(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts, capacity=1024):
    """Every id once, pieces in place, sequences gapless and not too long."""
    library = Tokenizer.from_file(FILE)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
        ids = np.array(want[r.doc_id][r.start:r.start + r.length], "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32
    for i, ids in want.items():
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert sum(r.length for r in own) == len(ids)
        assert len(ids) > capacity or len(own) == 1
        assert all(r.length == capacity for r in own[1:])
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-sum(map(len, want.values())) // capacity)


def test_awkward_texts(frame, awkward, clashing):
    check(packing.pack(clashing(frame(awkward)), FILE).collect(), dict(enumerate(awkward)))


def test_given_documents_pack_tightly(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    used, least = check(packing.pack(docs, FILE).collect(), texts)
    assert used <= 1.03 * least + 1


def test_rounds_over_many_partitions(frame, prose):
    texts = [prose(n, n) for n in range(1, 260)]
    df = frame(texts).repartition(16)
    used, least = check(packing.pack(df, FILE, group=40).collect(), dict(enumerate(texts)))
    assert used <= 1.1 * least + 1


def bins_of(rows):
    """Filled places of every sequence."""
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    return sorted(used.values())


def test_bins_dealt_to_several_groups_end_where_nothing_fits(frame, prose):
    """More underfull bins than a group holds: rounds go on until none merge any more."""
    texts = [prose(n % 23, n) for n in range(400)]
    df = frame(texts).repartition(16)
    rows = packing.pack(df, FILE, capacity=100, group=3).collect()
    used, least = check(rows, dict(enumerate(texts)), 100)
    fewest, _ = check(packing.pack(df, FILE, capacity=100).collect(), dict(enumerate(texts)), 100)
    assert used <= 1.02 * fewest + 2


def test_a_small_item_fills_a_nearly_full_bin(frame):
    """No two sequences of a single group fit together, however little room they have."""
    texts = ["a b c d e f g h i"] * 30 + ["a"] * 7 + [""] * 20
    df = frame(texts).repartition(12)
    rows = packing.pack(df, FILE, capacity=11).collect()
    check(rows, dict(enumerate(texts)), 11)
    small, second = bins_of(rows)[:2]
    assert small + second > 11


def test_rounds_end_with_one_bin_a_group(frame):
    """Groups so small that bins which fit seldom meet: the rounds end, nothing is lost."""
    texts = ["a b c d e"] * 40 + ["a b c d"]
    used, _ = check(packing.pack(frame(texts).repartition(8), FILE, capacity=11, group=1).collect(),
                    dict(enumerate(texts)), 11)
    assert used in (40, 41)


def test_small_capacity_cuts_the_remainder_first():
    ids = np.arange(10, dtype="<u4").tobytes()
    assert [x[:3] for x in packing.pieces(ids, 4)] == [(0, 0, 2), (1, 2, 4), (2, 6, 4)]
    assert [x[:3] for x in packing.pieces(ids, 5)] == [(0, 0, 5), (1, 5, 5)]
    assert [x[:3] for x in packing.pieces(ids, 11)] == [(0, 0, 10)]


def test_best_fit_takes_the_fullest_bin():
    bins = packing.best_fit([6, 5, 5, 4], 10)
    assert sorted(map(sorted, bins)) == [[0, 3], [1, 2]]
    rng = random.Random(3)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)


def test_repeated_rows_missing_ids_and_empty_table(frame):
    rows = packing.pack(frame(["a b", "a b", None], [1, 1, None]), FILE).collect()
    assert sorted(repr(r.doc_id) for r in rows) == ["1", "1", "None"]
    assert len({r.sequence_id for r in rows}) == 1 and {r.length for r in rows} == {1, 3}
    assert packing.pack(frame([]), FILE).count() == 0
