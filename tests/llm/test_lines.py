from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from chorus.llm import lines


def near(a, b):
    """At most one word deleted, inserted or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(rows):
    seen, out = [], {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[i] = None
            continue
        kept = []
        for line in text.split("\n"):
            w = [x for x in re.split("[ \t\x0b\f\r]+", line) if x]
            if not w:
                kept.append(line)
                continue
            gone = any(w == s or (len(w) >= 5 and len(s) >= 5 and near(w, s)) for s in seen)
            seen.append(w)
            if not gone:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def edited(rng, words, line):
    w = line.split(" ")
    for _ in range(rng.choice((0, 1, 1, 1, 2))):
        at = rng.randrange(len(w))
        kind = rng.choice("dir")
        if kind == "d" and len(w) > 1:
            del w[at]
        elif kind == "i":
            w.insert(at, rng.choice(words))
        else:
            w[at] = rng.choice(words)
    return " ".join(w)


def test_lines_like_brute_force(frame, words, clashing):
    rng = random.Random(8)
    pool = [" ".join(rng.choice(words[:30]) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    pool += ["a a a a a a", "a a a a a", "a b a b a b", "b a b a b a", "", "  "]
    texts = ["\n".join(edited(rng, words, rng.choice(pool)) if rng.random() < 0.7 else rng.choice(pool)
                       for _ in range(rng.randint(1, 8))) for _ in range(120)] + [None, "", "\n"]
    docs = clashing(frame(texts))
    kept = lines.dedup_lines(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()} == brute(enumerate(texts))


def test_awkward_texts(frame, awkward):
    got = lines.dedup_lines(frame(awkward), counts=("n_lines", "n_dropped")).collect()
    want = brute(enumerate(awkward))
    assert {r.doc_id: r.text for r in got} == want
    for r in got:
        n = 0 if awkward[r.doc_id] is None else len(awkward[r.doc_id].split("\n"))
        assert r.n_lines == n
        assert r.n_dropped == n - (0 if r.text is None else len(r.text.split("\n")) if want[r.doc_id]
                                   or n == 1 and r.n_dropped == 0 else 0)


def test_one_line_in_all_rows(frame):
    docs = frame([f"the same line everywhere here\nline {i} of the row number {i * 7}" for i in range(300)])
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == brute((r.doc_id, r.text) for r in docs.collect())


def test_repeated_rows_missing_ids_and_empty_table(frame):
    got = lines.dedup_lines(frame(["a b", "a b", "a b", "c"], [1, 1, None, 2])).collect()
    assert sorted((repr(r.doc_id), r.text) for r in got) == [
        ("1", "a b"), ("1", "a b"), ("2", "c"), ("None", "")]
    assert lines.dedup_lines(frame([])).count() == 0


def test_no_python_in_the_plan(frame):
    df = lines.dedup_lines(frame(["a b c d e f", "a b c d e g"]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_keys_of_variants_are_those_of_the_shorter_lines(spark):
    """Every variant has the key of the line it is, and words are hashed once each, not per variant."""
    texts = ["a b c d e f", "a a a a a", "x y x y x y x", " ".join(f"w{i % 7}" for i in range(40))]
    shorter = [[w[:i] + w[i + 1:] for i in range(len(w))] for w in map(str.split, texts)]
    rows = [(n, w) for n, (t, s) in enumerate(zip(texts, shorter)) for w in [t.split(), *s]]
    made = spark.createDataFrame(rows, "line int, words array<string>").select(
        "line", "words", lines._keys(F.col("words")).alias("keys")).collect()
    whole = {tuple(r.words): r.keys[0] for r in made}
    assert len(set(whole.values())) == len(whole)
    for n, text in enumerate(texts):
        keys = next(r.keys for r in made if list(r.words) == text.split())
        assert keys[1:] == [whole[tuple(w)] for w in shorter[n]]

    long = " ".join(f"w{i}" for i in range(6000))  # 36 million hashes of words, if taken per variant
    plan = spark.createDataFrame([(long.split(),)], "words array<string>").select(
        F.size(lines._keys(F.col("words"))))
    assert plan.first()[0] == 6001
