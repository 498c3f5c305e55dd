"""Word vectors: parts, passes and averages, against plain sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from chorus.config import Word2VecConfig
from chorus.plans import models, wordvec


@pytest.fixture(scope="module")
def groups(spark):
    """Texts of two groups of words that never meet, a frequent word in both, and rare words."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        own = [f"{'ab'[i % 2]}{j}" for j in rng.integers(0, 6, 30)]
        rows.append((i, [w for pair in zip(own, ["both"] * 30) for w in pair] + [f"rare{i}"]))
    rows += [(400, []), (401, None), (402, ["both"] * 3000)]
    return spark.createDataFrame(rows, "id int, words array<string>")


CONFIG = Word2VecConfig(vector_size=20)


@pytest.fixture(scope="module")
def model(groups):
    return models.train_word2vec(groups, "words", CONFIG)


def test_vectors_are_a_table_of_the_frequent_words(model):
    table = model.getVectors()
    assert table.inputFiles()  # not rows that the driver holds
    held = {r.word: np.array(r.v) for r in table.select("word", vector_to_array("vector").alias("v")).collect()}
    assert set(held) == {"both", *[f"{g}{j}" for g in "ab" for j in range(6)]}
    assert all(len(v) == 20 and np.isfinite(v).all() for v in held.values())


def test_words_of_like_windows_are_near(model):
    held = {r.word: np.array(r.v) for r in
            model.getVectors().select("word", vector_to_array("vector").alias("v")).collect()}
    near = lambda a, b: held[a] @ held[b] / np.linalg.norm(held[a]) / np.linalg.norm(held[b])
    inside = [near(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(6) for j in range(i)]
    across = [near(f"a{i}", f"b{j}") for i in range(6) for j in range(6)]
    assert min(inside) > max(across) + 0.1  # "both" in all windows draws the groups together


def test_texts_are_means_of_their_words(spark, model):
    held = {r.word: np.array(r.v) for r in
            model.getVectors().select("word", vector_to_array("vector").alias("v")).collect()}
    rows = spark.createDataFrame([(1, ["a1", "a1", "b2", "unknown"]), (2, []), (3, None)],
                                 "id int, words array<string>")
    got = {r.id: np.array(r.v) for r in model.transform(rows).select("id", vector_to_array("vector").alias("v")).collect()}
    assert np.allclose(got[1], (2 * held["a1"] + held["b2"]) / 4)
    assert not got[2].any() and not got[3].any() and len(got[2]) == 20


def test_same_vectors_again(groups, model):
    again = models.train_word2vec(groups, "words", CONFIG).getVectors()
    assert again.exceptAll(model.getVectors()).count() == 0


def test_average_of_parts_over_batches():
    rng = np.random.default_rng(2)
    rows = [(w, p, rng.normal(size=4).astype(np.float16)) for w, n in (("a", 5), ("b", 1), ("c", 3)) for p in range(n)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([7] * 9), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2].tobytes() for r in rows], pa.binary())], names=["word", "n", "part", "state"])
    for step in (1, 2, 4, 9):
        found = list(wordvec._averaged(2)(batch.slice(i, step) for i in range(0, 9, step)))
        got = [r for b in found for r in b.to_pylist()]
        assert [(r["word"], r["n"], r["parts"]) for r in got] == [
            ("a", 7, [0, 1, 2, 3, 4]), ("b", 7, [0]), ("c", 7, [0, 1, 2])]
        for r in got:
            want = np.mean([v.astype(np.float32) for w, _, v in rows if w == r["word"]], axis=0)
            assert np.allclose(np.frombuffer(r["state"], np.float16), want, atol=2e-3)
    assert list(wordvec._averaged(2)(iter([]))) == []


def test_a_pass_is_the_gradient_of_pairs_and_noise():
    """One block: the moves are those of all pairs in the windows and of their share of the noise."""
    config, n, size = Word2VecConfig(vector_size=6, window=3), 9, 6
    rng = np.random.default_rng(3)
    centre, window = (rng.normal(size=(n, size)).astype(np.float32) for _ in range(2))
    ids, text = rng.integers(0, n, 20), np.repeat([0, 1], [12, 8])
    counts = np.arange(1, n + 1)
    noise = wordvec.Noise(np.arange(n), np.cumsum(counts ** 0.75))
    moved, moved_window = centre.copy(), window.copy()
    wordvec.learn(wordvec.Tokens(ids, text), moved, moved_window, noise, np.random.default_rng(4), config, 0)

    drawn = np.random.default_rng(4)
    wide = drawn.integers(1, 4, (1, wordvec.CENTRES))[0]
    k = np.searchsorted(noise.ends, drawn.random(wordvec.NOISE) * noise.ends[-1], "right")
    up, up_window = np.zeros((n, size)), np.zeros((n, size))
    weight, weight_window = np.zeros(n), np.zeros(n)
    for i in range(20):
        for j in range(20):
            if i == j or abs(i - j) > wide[i] or text[i] != text[j]:
                continue
            for other, sign, w in [(ids[j], 1, 1.0), *[(x, 0, 5 / len(k)) for x in k if x != ids[j]]]:
                g = w * (sign - 1 / (1 + np.exp(-centre[ids[i]] @ window[other])))
                up[ids[i]] += g * window[other]
                up_window[other] += g * centre[ids[i]]
                weight[ids[i]] += w
                weight_window[other] += w
    step = lambda w: np.minimum(config.step, 1 / np.maximum(w, 1e-9))[:, None]
    assert np.allclose(moved - centre, up * step(weight), atol=1e-4)
    assert np.allclose(moved_window - window, up_window * step(weight_window), atol=1e-4)


def test_the_disk_holds_one_pass(spark, groups, monkeypatch):
    """Shuffle files and states of earlier passes were left where they were."""
    import time

    made, stage, blocks = [], wordvec.stage, []
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return sum(1 for file in manager.getAllFiles().mkString("\n").split("\n") if file.endswith(".data"))

    def look(df, purpose):
        made.append(stage(df, purpose))
        deadline = time.time() + 20
        while blocks and shuffled() > max(blocks[:3]) and time.time() < deadline:
            time.sleep(0.2)  # the cleaner runs beside the passes
        blocks.append(shuffled())
        return made[-1]

    monkeypatch.setattr(wordvec, "stage", look)
    spark.sparkContext._jvm.System.gc()
    model = models.train_word2vec(groups, "words", Word2VecConfig(vector_size=4, epochs=6))
    assert model.getVectors().count() == 13
    held = [df for df in made if any(file.exists() for file in map(_local, df.inputFiles()))]
    assert held == [made[-1]]  # the vectors
    assert max(blocks[3:]) <= 3 * max(blocks[2], 1)


def _local(uri):
    from pathlib import Path
    from urllib.parse import unquote, urlparse

    return Path(unquote(urlparse(uri).path))
