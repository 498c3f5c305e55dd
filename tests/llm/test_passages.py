from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from chorus.llm import passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first: dict[tuple, int] = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for at in range(len(w) - window + 1):
            key = tuple(w[at:at + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for at in range(len(w) - window + 1):
            if first[tuple(w[at:at + window])] < i:
                gone.update(range(at, at + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(words, n, seed, window):
    """Texts that share passages of about the window, copies, edited copies and repetition."""
    rng = random.Random(seed)
    pool = [[rng.choice(words) for _ in range(rng.randint(window // 2, window * 3))] for _ in range(12)]
    texts = []
    for _ in range(n):
        w: list[str] = []
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.4:
                p = list(rng.choice(pool))
                a = rng.randrange(len(p))
                w += p[a:] if rng.random() < 0.3 else p
            elif kind < 0.5:
                w += [rng.choice(words[:2])] * rng.randint(1, window * 2)
            else:
                w += [rng.choice(words) for _ in range(rng.randint(1, window * 2))]
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
    return texts + texts[:5]


def result(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("hot", [512, 3])
def test_like_brute_force(frame, words, clashing, hot):
    texts = corpus(words, 90, 1, 12)
    got = passages.dedup_passages(clashing(frame(texts)), window=12, gram=4, hot=hot)
    assert result(got) == brute(enumerate(texts), 12)


def test_production_window(frame, words, awkward):
    texts = corpus(words, 40, 2, 50) + awkward
    assert result(passages.dedup_passages(frame(texts))) == brute(enumerate(texts), 50)


def test_a_passage_in_all_documents(frame, words, prose):
    common = prose(70, 5)
    texts = [f"{prose(20, 100 + i)} {common} {prose(30, 300 + i)}" for i in range(120)]
    assert result(passages.dedup_passages(frame(texts), hot=16)) == brute(enumerate(texts), 50)


def test_index_finds_the_windows_of_its_passages(words):
    rng = random.Random(6)
    pool = [rng.choice(words[:4]) for _ in range(60)]
    rows = [pool[a:a + rng.randint(5, 20)] for a in range(0, 40)]
    owners = np.array(rng.sample(range(100), len(rows)))
    index = passages.FMIndex(rows, owners, window=5)
    got = sorted(zip(*(x.tolist() for x in index.matches())))
    want = []
    for i, r in enumerate(rows):
        for at in range(len(r) - 4):
            own = [o for s, o in zip(rows, owners.tolist())
                   if any(s[k:k + 5] == r[at:at + 5] for k in range(len(s) - 4))]
            want.append((i, at, min(own)))
    assert got == sorted(want)


def test_wavelet_ranks():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 37, 1000)
    w = passages.Wavelet(x, 37)
    c, a, b = rng.integers(0, 37, 300), rng.integers(0, 1001, 300), rng.integers(0, 1001, 300)
    low, high = w.rank(c, a, b)
    assert low.tolist() == [int((x[:k] == s).sum()) for s, k in zip(c, a)]
    assert high.tolist() == [int((x[:k] == s).sum()) for s, k in zip(c, b)]


def test_repeated_rows_missing_ids_and_empty_table(frame, prose):
    t = prose(80, 1)
    rows = passages.dedup_passages(frame([t, t, t, None, t + " x"], [2, 2, None, 5, 9])).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed) for r in rows) == [
        ("2", 80, 0), ("2", 80, 0), ("5", 0, 0), ("9", 81, 80), ("None", 80, 80)]
    assert passages.dedup_passages(frame([])).count() == 0


@pytest.mark.parametrize(("n", "at"), [(40, 20), (23, 11), (17, 5), (12, 0), (14, 9)])
def test_narrower_passages_hold_every_window_of_a_gram_once(n, at):
    window, gram, seen = 12, 3, []
    grams = [(at, gram)]
    while grams:
        made = passages.narrower(*np.array(grams).T, n, window).tolist()
        grams = [(g, size) for g, size, _, _ in made if size < window]
        for g, size, start, length in made:
            assert start <= g and g + size <= start + length <= n
            if size == window:
                assert (start, length) == (g, window)
                seen.append(start)
    assert sorted(seen) == [s for s in range(n - window + 1) if s <= at and at + gram <= s + window]


@pytest.mark.parametrize("seed", [3, 4])
def test_hot_anchors_in_repetitive_short_texts(frame, words, seed):
    """Anchors that occur several times in a passage, cut off at both ends of a text."""
    rng = random.Random(seed)
    base = [rng.choice(words[:2]) for _ in range(40)]
    texts = []
    for _ in range(60):
        a = rng.randrange(20)
        w = base[a:a + rng.randint(8, 22)]
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = rng.choice(words[:3])
        texts.append(" ".join(w))
    texts += texts[:10]
    ids = rng.sample(range(500), len(texts))
    got = passages.dedup_passages(frame(texts, ids), window=8, gram=2, hot=1)
    assert result(got) == brute(zip(ids, texts), 8)


def test_copies_of_a_text_need_no_search(frame, prose):
    texts = [prose(60, 1), prose(60, 1), prose(49, 2), prose(49, 2), prose(60, 1).replace(" ", "  "), None, None]
    got = passages.dedup_passages(frame(texts, [9, 4, 5, 6, 7, 1, 2]))
    assert result(got) == brute(zip([9, 4, 5, 6, 7, 1, 2], texts), 50)


def test_texts_are_read_by_one_python_function_a_task(spark):
    """A test in Python beside the search for anchors doubles the workers an executor has to hold."""
    docs = spark.createDataFrame([(1, 1, b"a b"), (2, 2, b"a b")], "doc long, version long, t binary")
    found = passages._with_texts(docs.select("doc", "version", F.lit(0).alias("start")), docs, "start")
    assert "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 2
