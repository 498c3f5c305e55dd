from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np

from chorus.llm import exact

WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in WHITE)].append((-len(t or ""), i))
    out = []
    for norm, members in groups.items():
        chars, keep = min(members)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep, len(members), i == keep and c == chars, sha) for c, i in members]
    return sorted(out)


def test_groups_like_brute_force(frame, awkward, clashing):
    texts = awkward * 2 + [awkward[5]] * 40
    df = frame(texts)
    got = sorted(map(tuple, exact.exact_duplicates(clashing(df)).collect()))
    assert got == brute(list(enumerate(texts)))


def test_missing_and_repeated_ids(frame):
    df = frame(["a b", "ab", "ab", "other", "ab"], [7, 3, 3, None, None])
    got = sorted(map(tuple, exact.exact_duplicates(df).select(
        "doc_id", "keep_id", "group_size", "kept").collect()), key=repr)
    assert got == sorted([(7, 7, 4, True), (3, 7, 4, False), (3, 7, 4, False), (None, 7, 4, False),
                          (None, None, 1, True)], key=repr)


def test_rows_that_tie_stay_together(frame):
    df = frame(["same", "same"], [5, 5])
    got = [(r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(df).collect()]
    assert got == [(5, 2, True)] * 2


def test_empty_table(frame):
    assert exact.exact_duplicates(frame([])).count() == 0


def test_filters_hold_and_merge_without_loss():
    rng = np.random.default_rng(1)
    part = np.uint64(37)
    high = part << np.uint64(64 - exact.RANGE_BITS)
    draws = [np.unique(rng.integers(0, 1 << 56, 5000, dtype=np.uint64)[rng.integers(0, 5000, 9000)],
                       return_counts=True) for _ in range(3)]
    filters = [(k | high, c.astype(np.uint64)) for k, c in draws]
    for keys, counts in filters:
        back = exact.unpack(exact.pack(keys, counts), int(part))
        assert np.array_equal(back[0], keys) and np.array_equal(back[1], counts)
    merged = exact.merge(filters)
    want = defaultdict(int)
    for keys, counts in filters:
        for k, c in zip(keys.tolist(), counts.tolist()):
            want[k] += c
    assert dict(zip(merged[0].tolist(), merged[1].tolist())) == want
