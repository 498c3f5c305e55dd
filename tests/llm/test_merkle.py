from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from chorus.llm import merkle


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def ancestors(nodes):
    """All levels up to a single node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H("".join(last[i:i + 16])) for i in range(0, len(last), 16)])
    return levels


def around(levels, at):
    for level in levels[:-1]:
        first = at - at % 16
        yield "".join(level[first:at]), "".join(level[at + 1:first + 16])
        at //= 16


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) from rows (id, source, lang, n, text)."""
    groups = defaultdict(list)
    for i, t, lang, source, n in rows:
        row = (i, source, lang, n, t)
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        changed = leaf((*row[:4], lowered(t))) if tampered else None
        groups[source].append((i is None, i or 0, leaf(row), changed))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: ancestors([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = ancestors([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (missing, i, own, changed) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = [*around(trees[s], at), *around(top, k)]
            folded = changed or own
            for a, b in path:
                folded = H(a + folded + b)
            out.append((None if missing else i, own, trees[s][-1][0], top[-1][0],
                        H("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def found(df):
    got = merkle.manifest(df, merkle.one_in(5), {"text": merkle.lower_ascii("text")})
    return sorted((tuple(r)[:7] for r in got.drop("copies").collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def test_like_brute_force_with_a_hot_source_and_odd_groups(spark, awkward, clashing):
    """Sources of 1, 16, 17, 256, 257 and many leaves, a null and an empty one."""
    sizes = {"one": 1, "run": 16, "more": 17, "block": 256, "over": 257, "hot": 4500, None: 3,
             "": 2, "é": 33, "Z": 2, "ａ": 1}
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i * 7 % 100_003, awkward[i % len(awkward)], [None, "en"][i % 2], source,
                         [None, i][i % 3 > 0]))
            i += 1
    assert found(clashing(table(spark, rows))) == brute(rows)


def test_many_sources_climb_over_several_rounds(spark):
    rows = [(i, f"Text {i % 7}", "en", f"s{i % 700}", i) for i in range(900)]
    assert found(table(spark, rows)) == brute(rows)


def test_missing_and_repeated_ids(spark):
    rows = [(None, "A", "en", "s", 1), (3, "B", "en", "s", 1), (3, "A", "en", "s", 1),
            (3, "A", "en", "s", 1), (None, None, None, None, None)]
    assert found(table(spark, rows)) == brute(rows)


def test_one_leaf_is_the_root(spark):
    rows = [(10, "No CHANGE", None, None, None)]
    assert found(table(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert found(table(spark, [])) == []


def test_a_version_copies_only_its_ancestors(spark):
    rows = [(i, f"Text {i}", "en", "s" if i < 600 else "t", i) for i in range(620)]
    got = merkle.manifest(table(spark, rows), merkle.one_in(5),
                          {"text": merkle.lower_ascii("text")}).collect()
    for r in got:
        tampered = zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert (r.copies is not None) == tampered
        if tampered:  # leaf, the levels of the source, those of the two sources
            assert len(r.copies) == 1 + (3 if r.doc_id < 600 else 2) + 1
            assert r.copies[-1] == r.folded_root and r.copies[0] != r.leaf and not r.verified


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256])
def test_siblings_fold_to_the_top(n):
    nodes = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    levels = merkle.climb(nodes, n)
    assert len(levels[-1]) == 1
    for at in range(n):
        assert merkle.copied(nodes[at], merkle.siblings(levels, at))[-1] == levels[-1][0]


def test_the_last_block_of_a_large_tree_climbs_all_levels():
    assert len(merkle.climb([b"x" * 32], 257)) == 1 + merkle.LEVELS
