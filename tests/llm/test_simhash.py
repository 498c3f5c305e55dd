from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from chorus.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    if not words:
        return 0
    shingles = ([" ".join(words)] if len(words) < 3 else
                [" ".join(words[i:i + 3]) for i in range(len(words) - 2)])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    label = {f: f for f in fps}
    todo = set(fps)
    while todo:
        seed = todo.pop()
        stack, seen = [seed], {seed}
        while stack:
            x = stack.pop()
            near = [y for y in todo if bin(x ^ y).count("1") <= 3]
            todo.difference_update(near)
            seen.update(near)
            stack.extend(near)
        for x in seen:
            label[x] = min(seen)
    return label


def test_fingerprints_like_brute_force(awkward):
    for t in awkward:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def cloud(n, seed, spread=6):
    """Fingerprints with many near ones: balls of balls around a few centres."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice((1, 3, 40))):
            out.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, spread)))
    return sorted(out)


@pytest.mark.parametrize("bits", [4, 12])
def test_links_of_a_group_connect_what_is_near(bits):
    fps = cloud(600, bits)
    edges = []
    groups: dict[int, list] = {}
    for f in fps:
        for m in simhash._masks(bits):
            flips = bin(m).count("1")
            if flips <= 2 - bin(f).count("1") % 2:
                groups.setdefault((f >> (64 - bits)) ^ m, []).append((f, flips))
    for members in groups.values():
        a, b = simhash.links(np.array([f for f, _ in members], np.uint64),
                             np.array([n for _, n in members]), 64 - bits)
        edges += list(zip(a.tolist(), b.tolist()))
    at = {f: i for i, f in enumerate(fps)}
    label = simhash.local_labels(len(fps), np.array([at[a] for a, _ in edges]),
                                 np.array([at[b] for _, b in edges]))
    want = brute_components(fps)
    assert [fps[i] for i in label] == [want[f] for f in fps]


@pytest.mark.parametrize("group", [10, 100, 10**6])
def test_components_like_brute_force(spark, group):
    fps = cloud(500, 11) + [0, 1, 3, 7]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long").distinct()
    roots = {r.u: r.v for r in simhash.components(simhash.near_pairs(nodes, group)).collect()}
    want = brute_components(sorted(set(fps)))
    got = {f: roots.get(s, s) for f, s in zip(fps, signed)}
    classes = {}
    for f in fps:
        classes.setdefault(want[f], set()).add(got[f])
    assert all(len(c) == 1 for c in classes.values())
    assert len({min(c) for c in classes.values()}) == len(classes)


def test_documents_like_brute_force(frame, awkward, clashing, prose):
    texts = awkward + [prose(300, 9), prose(300, 9) + " x", prose(300, 9) + " y z"] + [awkward[5]] * 30
    got = {r.doc_id: r for r in simhash.near_duplicates(clashing(frame(texts))).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    label = brute_components(sorted(set(fps)))
    for i, f in enumerate(fps):
        assert got[i].fingerprint == f"{f:016x}"
        assert got[i].component_id == min(j for j, g in enumerate(fps) if label[g] == label[f])
        assert got[i].component_size == sum(label[g] == label[f] for g in fps)


def test_one_of_each_group_stays(frame, clashing, prose):
    base = prose(200, 1)
    docs = clashing(frame([base, base, prose(200, 2), base + "", None, ""], [5, 2, 9, 2, 8, None]))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 2, 8, 9]


def test_missing_ids_and_empty_table(frame):
    got = simhash.near_duplicates(frame(["a b c d"] * 2, [None, None])).collect()
    assert [r.component_id for r in got] == [None, None]
    assert simhash.near_duplicates(frame([])).count() == 0
