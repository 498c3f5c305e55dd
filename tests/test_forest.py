"""The forest over columns, against plain numpy and the forest of Spark ML."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from test_training import few, probabilities, table

from chorus.catalog.training import features
from chorus.config import BoostConfig, ForestConfig
from chorus.plans import blocks, boosting, columns, forest, models


def plain_tree(x, y, weight, depth, least, classes):
    """Class shares of the rows' leaves, choosing among all features."""
    shares = np.zeros((len(x), classes))
    nodes = [np.arange(len(x))]
    for level in range(depth + 1):
        following = []
        for rows in nodes:
            count = lambda part: np.bincount(y[part], weight[part], classes)
            impurity = lambda c: c.sum() - (c ** 2).sum() / max(c.sum(), 1)
            total, best = count(rows), (1e-12,)
            shares[rows] = total / total.sum()
            if level == depth:
                continue
            for j in range(x.shape[1]):
                for t in np.unique(np.append(x[rows, j], 0.0)):
                    right = rows[x[rows, j] > t]
                    left = rows[x[rows, j] <= t]
                    a, b = count(left), count(right)
                    gain = (impurity(total) - impurity(a) - impurity(b)) / total.sum()
                    if min(a.sum(), b.sum()) >= least and gain > best[0] + 1e-9:
                        best = (gain, left, right)
            if len(best) == 3:
                following += best[1:]
        nodes = following
    return shares


def test_a_tree_equals_a_plain_one(spark, few, monkeypatch):
    x, y = few
    df = table(spark, x, y).repartition(1).sortWithinPartitions("id")
    # All features at every node, as one distinct feature set: the square root is lifted.
    monkeypatch.setattr(np, "sqrt", lambda v: v)
    model = forest.SparseForest(3, "id", ForestConfig(trees=1, max_depth=3, min_leaf=4, seed=1)).fit(df)
    monkeypatch.undo()
    # Rows are numbered by their place in the blocks.
    block = blocks.block(blocks.row_blocks(df, "id", "label", 1).first())
    dense = np.zeros(x.shape)
    dense[block.row_of_entry(), block.indices] = block.values
    want = plain_tree(dense, block.labels, forest.bootstrap(1, 0, len(x)).astype(float), 3, 4, 3)
    got = probabilities(model, df)
    by_row = {tuple(a): p for a, p in zip(dense, want)}
    assert np.allclose(got, [by_row[tuple(a)] for a in x], atol=1e-9)


def test_blocks_and_groups_of_trees_change_nothing(spark, few, monkeypatch):
    x, y = few
    df = table(spark, x, y)
    config = ForestConfig(trees=6, max_depth=5)
    one = probabilities(forest.SparseForest(3, "id", config).fit(df), df)
    monkeypatch.setattr(forest, "STATE", 500)
    assert np.allclose(probabilities(forest.SparseForest(3, "id", config).fit(df), df), one, atol=1e-12)
    # More blocks number the rows otherwise, which is another sample of each tree.
    monkeypatch.setattr(blocks, "ENTRIES", 250)
    other = probabilities(forest.SparseForest(3, "id", config).fit(df), df)
    assert (other.argmax(axis=1) == one.argmax(axis=1)).mean() > 0.8


def test_features_of_a_node_differ_and_are_uniform():
    for size, many in ((9, 3), (10_000, 100)):
        chosen = forest.chosen_features(7, 2, 3, 400, size, many)
        held = [row[row >= 0] for row in chosen]
        assert all(len(set(r.tolist())) == len(r) == many for r in held)
        counts = np.bincount(np.concatenate(held) * 9 // size, minlength=9)
        assert counts.min() > 0.8 * counts.max()
    assert forest.chosen_features(7, 2, 3, 2, 3, 3).tolist() == [[0, 1, 2]] * 2


def test_samples_of_trees():
    weight = forest.bootstrap(3, 1, 200_000)
    assert abs(weight.mean() - 1) < 0.02 and abs(weight.astype(float).var() - 1) < 0.02
    assert abs((weight == 0).mean() - np.exp(-1)) < 0.01


def test_saved_loaded_and_awkward(spark, few):
    x, y = few
    df = table(spark, x, y)
    model = forest.SparseForest(3, "id", ForestConfig(trees=5)).fit(df)
    again = models.save_and_load(model, spark)
    assert np.array_equal(probabilities(again, df), probabilities(model, df))
    single = table(spark, np.zeros((1, 3)), np.array([1]))
    p = probabilities(forest.SparseForest(2, "id", ForestConfig(trees=8)).fit(single), single)
    assert p.argmax() == 1
    with pytest.raises(Exception, match="zero or positive"):
        forest.SparseForest(3, "id", ForestConfig(trees=1)).fit(table(spark, -x, y))


def test_as_good_as_the_forest_of_spark(spark, data):
    f = features(spark, data)
    held_out = f.table.filter("split <> 'train'")
    theirs = RandomForestClassifier(numTrees=20, maxDepth=10, minInstancesPerNode=4, seed=42).fit(
        models.train_rows(f))
    ours = models.train_forest(f, ForestConfig(trees=20, max_depth=10))
    right = [m.transform(held_out).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
             for m in (ours, theirs)]
    assert right[0] >= right[1] - 0.05  # a few dozen rows; on 201 and 2,002 held-out rows they are alike


def test_no_sums_are_shuffled_for_many_blocks(spark, few, monkeypatch):
    """Boosting asks for bits of rows only; sums per block, node and bin would be merged by key."""
    x, y = few
    monkeypatch.setattr(blocks, "ENTRIES", 100)
    df = table(spark, x, y)
    config = BoostConfig(rounds=3, max_depth=3)
    want = probabilities(boosting.SoftmaxBoosting(3, "id", config).fit(df), df)
    dealt = columns.deal(df, "id", "label", "features", 32)
    held = dealt.ranges.collect()
    assert len(held) == len(dealt.cuts) - 1 <= 7  # whole columns, however many blocks there are
    assert sum(len(c.rows) for c in held) == np.count_nonzero(x)
    assert all(len(c.labels) == len(x) for c in held)
    monkeypatch.setattr(boosting, "EAGER", 0)  # bits of chosen splits only
    assert np.allclose(probabilities(boosting.SoftmaxBoosting(3, "id", config).fit(df), df), want, atol=1e-12)


def test_bins_come_in_jobs_whose_number_is_not_that_of_the_partitions(spark, few):
    """Quantile bins were fetched partition by partition, a job each."""
    x, y = few
    df = table(spark, x, y)
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    most = {}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in (4, 24):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            context.setJobGroup(f"bins-{parts}", "bins")
            columns.feature_bins(df, x.shape[1], 32)
            most[parts] = len(tracker.getJobIdsForGroup(f"bins-{parts}"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert most[4] == most[24]
