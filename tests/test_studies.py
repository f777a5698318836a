"""Operators of names, tables and bars against plain loops."""

import random

from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import evaluate, runlog, tables


def test_nearest_rows_over_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(-40, 90), rng.randrange(3), i, f"v{i}") for i in range(40)]
    items = [(i, rng.choice("abc"), rng.randrange(-60, 120)) for i in range(80)]
    got = tables.annotate(spark.createDataFrame(items, "item long, key string, page long"), spark.createDataFrame(rows, "key string, row_page long, table_pos long, row_pos long, value string"), block=8)
    best = lambda key, page: min(((abs(p - page), t, r, v) for k, p, t, r, v in rows if k == key), default=(0, 0, 0, "N/A"))[3]
    assert sorted(map(tuple, got.collect())) == sorted((i, page, best(key, page)) for i, key, page in items)
    none = tables.annotate(spark.createDataFrame(items, "item long, key string, page long"), spark.createDataFrame([], "key string, row_page long, table_pos long, row_pos long, value string"))
    assert {r["value"] for r in none.collect()} == {"N/A"}


def test_named_as(spark):
    rows = [(1, "Long", "BARREL MODS"), (2, "Marksman's Stock", "Stock Mods"), (3, "Drum", "Magazines"), (4, "", "Magazines"), (5, "Short", "")]
    items = [(1, "Long Barrel"), (2, "Marksman's"), (3, "drum magazine"), (4, "Drum Magazines"), (5, "Barrel"), (6, "short"), (7, "")]
    got = tables.named_as(spark.createDataFrame(rows, "i int, name string, grp string"), spark.createDataFrame(items, "j int, item string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2), (3, 3), (3, 4), (5, 6)]


def test_text_forms(spark):
    one = lambda f, *x: spark.createDataFrame([x], [f"c{i}" for i in range(len(x))]).select(f(*[F.col(f"c{i}") for i in range(len(x))])).head()[0]
    assert one(text.bare, "Athletics........DEX") == "Athletics"
    assert one(text.bare, "Martial Arts (x2)") == "Martial Arts"
    assert one(text.bare, "Name: ") == "Name:" and one(text.bare, "Name:") == "Name"
    assert one(text.same_words, "  What\n IS  it? ") == "what is it?"
    assert one(text.rich_text, "q", ["a", "b", "c", "d"]) == "q\nSections: a; b; c"
    assert one(text.run_in_hash, "#run=a-1_b") == "a-1_b" and one(text.run_in_hash, "#run=a b") is None


def test_bars(spark):
    rng = random.Random(5)
    data = [(rng.randrange(3), rng.randrange(20), rng.random() < 0.6) for _ in range(300)]
    got = evaluate.refitted(spark.createDataFrame(data, "fold int, value int, good boolean"), "fold", 3, 0.62)
    want = []
    for held in range(3):
        others = [(v, g) for f, v, g in data if f != held]
        bars = [(sum(g for v, g in others if v >= b), b) for b in {v for v, _ in others} if sum(g for v, g in others if v >= b) >= 0.62 * sum(v >= b for v, _ in others)]
        if bars:
            bar, own = max(bars)[1], [(v, g) for f, v, g in data if f == held]
            want.append((held, bar, sum(g for v, g in own if v >= bar), sum(v >= bar for v, _ in own), sum(g for _, g in own)))
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_gate_ranks(spark):
    rng = random.Random(7)
    similar = [(b, p, rng.randrange(-10**6, 10**6) // 50_000 * 50_000) for b in "xy" for p in range(60)]
    gates = [(b, p, p) for b in "xy" for p in range(0, 60, 3)]
    got = evaluate.gate_rows(spark.createDataFrame(gates, "book string, page long, p long"), spark.createDataFrame(similar, "book string, page long, micro long"), spark.createDataFrame([("x", 3), ("x", 3)], "book string, page long"))
    order = {b: [p for _, p in sorted((-m, p) for k, p, m in similar if k == b)] for b in "xy"}
    assert {(r["book"], r["page"]): r["rank"] for r in got.collect()} == {(b, p): order[b].index(p) + 1 for b, p, _ in gates}
    assert [(r["book"], r["page"]) for r in got.where("answer").collect()] == [("x", 3)]


def test_logs_and_history(spark):
    lines = [(1, 0, 0, None, True), (1, 1, 1, 10, True), (1, 2, 1, 15, True), (1, 3, 0, None, True), (2, 0, 0, None, True), (3, 0, 0, 8, False)]
    got = runlog.in_flight(spark.createDataFrame(lines, "run int, idx int, depth int, cost long, stopped boolean"))
    assert sorted(map(tuple, got.collect())) == [(1, 13), (2, None)]
    runs = [("u", 1, 30, 1), ("u", 2, 50, 2), ("u", 3, 40, 3)]
    step = runlog.stepped(spark.createDataFrame(runs, "user string, id int, at int, place int")).orderBy("id")
    assert [(r["older"], r["newer"], r["successor"]) for r in step.collect()] == [(None, 3, 2), (3, None, 3), (1, 2, 2)]
    sizes = evaluate.modal(spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), ("a", 1), ("b", 5)], "g string, v int"), "g", "v")
    assert sorted(map(tuple, sizes.collect())) == [("a", 1, 2), ("b", 5, 1)]
    cells = spark.createDataFrame([("t", 0, "x", False), ("t", 1, "", False), ("t", 1, "note", True)], "t string, col int, cell string, lone boolean")
    assert [tuple(r) for r in tables.kept_columns(cells, "t").collect()] == [("t", 0)]
