"""Rules over two scores, against every pair at every bar."""

import random

from quire.operators import frontier


def made(seed):
    rng = random.Random(seed)
    return [(g, rng.choice([0, 100, rng.randint(0, 100), rng.randint(30, 70)]), rng.randint(0, 100), rng.random() < 0.6) for g in ("x", "y") for _ in range(70)] + [("z", 50, 50, True), ("w", 3, 4, False)]


def test_dominance(spark):
    pairs = made(1)
    rows = frontier.dominance(spark.createDataFrame(pairs, "k string, a int, b int, good boolean"), "k").collect()
    assert len(rows) == 4 * 101 * 101
    rng = random.Random(2)
    for r in rng.sample(rows, 300):
        own = [p for p in pairs if p[0] == r.k]
        both, under = [p for p in own if p[1] >= r.a and p[2] >= r.b], [p for p in own if p[1] < r.a and p[2] < r.b]
        assert (r.both, r.both_good, r.under, r.under_good, r.every) == (len(both), sum(p[3] for p in both), len(under), sum(p[3] for p in under), len(own))
        wrong = [p for p in own if not p[3]]
        assert r.a_over == max((p[1] for p in wrong if p[2] >= r.b), default=-100) and r.a_under == max((p[1] for p in wrong if p[2] < r.b), default=-100)
        assert r.b_over == max((p[2] for p in wrong if p[1] >= r.a), default=-100) and r.b_under == max((p[2] for p in wrong if p[1] < r.a), default=-100)


def test_widest_margin_on_ties(spark):
    pairs = spark.createDataFrame([("x", 80, 80, True), ("x", 60, 90, False), ("x", 90, 40, False)], "k string, a int, b int, good boolean")
    best = frontier.frontier(frontier.and_rules(frontier.dominance(pairs, "k")), "k", (100,)).collect()
    assert [(r.tp, r.taken, r.a, r.b, r.margin, r.cells) for r in best] == [(1, 1, 80, 60, 20, 20 * 40)]


def test_no_level_reached(spark):
    pairs = spark.createDataFrame([("x", 80, 80, False)], "k string, a int, b int, good boolean")
    grid = frontier.dominance(pairs, "k")
    assert frontier.frontier(frontier.or_rules(grid), "k").count() == 0
    assert frontier.frontier(frontier.sum_rules(pairs, "k").select("k", "rule", "a", "b", "taken", "tp", "margin"), "k").count() == 0
