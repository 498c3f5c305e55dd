"""Boosting persists columns only; scores follow from the bits of rounds."""

from __future__ import annotations

import numpy as np

from test_training import few, fitted, table  # noqa: F401

from chorus.config import BoostConfig
from chorus.plans import boosting, columns

CONFIG = BoostConfig(rounds=5, max_depth=3, step=0.3)


def test_columns_are_persisted_once_for_all_rounds(spark, few, monkeypatch):
    """With scores beside them they were written anew in every round."""
    x, y = few
    held, grow = [], boosting.grow_round

    def grow_and_look(*args):
        made = grow(*args)
        held.append(spark.sparkContext._jsc.getPersistentRDDs().size())
        return made

    monkeypatch.setattr(boosting, "grow_round", grow_and_look)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    fitted(table(spark, x, y), 3, CONFIG)
    assert held == [before + 1] * CONFIG.rounds
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


class Held:
    """A broadcast that needs no session."""

    def __init__(self, value):
        self.value = value


def test_known_rows_take_up_what_is_new():
    rng, n = np.random.default_rng(4), 50
    level = lambda: columns.Level(np.array([0], np.int32), np.array([1], np.int32),
                                  columns.pack(np.flatnonzero(rng.random(n) < 0.4), n))
    rounds = [([rng.normal(size=3), rng.normal(size=3)], [[level(), level()]]) for _ in range(4)]
    sent = lambda fit, many, *levels: boosting.Sent(
        fit, np.zeros(2), 0.5, [(Held(rounds[:2]), 2), *[(Held([r]), 1) for r in rounds[2:]]][:many], levels)
    boosting._KNOWN.clear()
    for at in (sent("a", 0), sent("a", 0, *rounds[0][1]), sent("a", 1), sent("a", 2, *rounds[3][1]), sent("a", 3),
               sent("a", 1), sent("b", 2), sent("a", 3)):
        rows = boosting.rows_now(at, n)
        fresh = boosting.Rows(at, n)
        for some, _ in at.rounds:
            for values, levels in some.value:
                fresh.add(values, levels)
        fresh.descend(at.levels)
        assert np.array_equal(rows.scores, fresh.scores)
        assert all(np.array_equal(a, b) for a, b in zip(rows.at, fresh.at))
    boosting._KNOWN.clear()


def test_pieces_change_nothing(spark, few, monkeypatch):
    x, y = few
    dealt = columns.deal(table(spark, x, y), "id", "label", "features", 32)
    for held in dealt.ranges.collect():
        rows = boosting.Rows(boosting.Sent("c", np.log([0.5, 0.3, 0.2]), 0.1, [], ()), len(x))
        for nodes in ([[0]] * 3, [[2], [], [1, 2, 5]]):
            found = []
            for at_once in (1, 100, 1 << 18):
                monkeypatch.setattr(boosting, "AT_ONCE", at_once)
                best = boosting.best_boundaries(held, rows, nodes, dealt.bins, 1)
                found.append([(o.k, o.best.tolist(), o.bins.tolist()) for o in best])
            for other in found[1:]:
                assert [(k, b) for k, _, b in other] == [(k, b) for k, _, b in found[0]]
                assert np.allclose(np.concatenate([g for _, g, _ in other]), np.concatenate([g for _, g, _ in found[0]]))
            rows.levels, rows.at = 1, [np.arange(len(x), dtype=np.int32) % 6 for _ in range(3)]


def test_ties_go_to_the_lower_feature(spark, few):
    """Like columns have like gains but for the rounding of the sums before them."""
    x, y = few
    model = fitted(table(spark, np.concatenate([x, x, x], axis=1), y), 3, CONFIG)
    alone = fitted(table(spark, x, y), 3, CONFIG)
    assert [t.feature for r in model.trees for t in r] == [t.feature for r in alone.trees for t in r]
