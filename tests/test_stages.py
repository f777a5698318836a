"""Tables filled in stages: what each stage may ask, and that a filled cell is never asked about again."""

from pyspark.sql import functions as F

from quire.operators import stages
from quire.plans.stage_queries import Recorded


class Watched(Recorded):
    """Keeps what it was asked."""

    def __init__(self):
        self.calls = []


def _watch(name):
    def call(self, asked):
        self.calls.append((name, asked))
        return getattr(Recorded, name)(self, asked)

    return call


for _name in ("own_columns", "labels", "entries", "derived", "searched", "pooled", "table_cells", "beside"):
    setattr(Watched, _name, _watch(_name))


def tables(spark):
    rows = spark.createDataFrame([(t, i, f"n{i}") for t in "abcdef" for i in range(8)], "tid string, i int, name string")
    columns = spark.createDataFrame([(t, j, c) for t in "abcdef" for j, c in enumerate(["u", "v", "w", "x"])], "tid string, j int, column string")
    return rows, columns


def test_nothing_filled_is_asked_about(spark):
    rows, columns = tables(spark)
    watched = Watched()
    cells, asked = stages.compose(rows, columns, watched, columns.where("column = 'u'"))
    assert [n for n, _ in watched.calls] == ["own_columns", "table_cells", "labels", "entries", "derived", "searched", "pooled", "table_cells", "derived", "beside"]
    held = {(r.tid, r.i, r.j): (r.text, r.stage) for r in cells.collect()}
    assert len(held) == cells.count() == 6 * 8 * 4
    at = {"own table": 1, "entries": 3, "own cells": 4, "searches": 7, "gaps": 8}
    asks = {}
    for k, (name, df) in enumerate(watched.calls):
        if name not in ("own_columns", "labels", "searched", "pooled", "beside"):
            for r in df.collect():
                text, stage = held[r.tid, r.i, r.j]
                assert stage is None or at[stage] >= k or (stage == "own cells" and k == 7), (name, r, stage)
                asks.setdefault((name, r.tid, r.i, r.j), []).append(k)
    assert max(len(v) for v in asks.values()) == 1 or all(len(v) == 1 for (n, *_), v in asks.items() if n == "derived")
    counted = {r.stage: r.n for r in asked.groupBy("stage").agg(F.sum("asked").alias("n")).collect()}
    assert counted["own table"] == 24 and counted["own cells"] == watched.calls[4][1].count() and counted.get("gaps", 0) == watched.calls[8][1].count()
    assert {s for _, s in held.values()} >= {"own table", "entries", "own cells"}


def test_no_columns(spark):
    rows, columns = tables(spark)
    cells, asked = stages.compose(rows, columns.where(F.lit(False)), Recorded())
    assert cells.count() == 0 and asked.count() == 0


def test_repeated_answers_fill_once(spark):
    class Twice(Recorded):
        def own_columns(self, columns):
            found = super().own_columns(columns)
            return found.unionByName(found)

        def table_cells(self, cells):
            found = super().table_cells(cells)
            return found.unionByName(found)

    rows, columns = tables(spark)
    cells, _ = stages.compose(rows, columns, Twice())
    assert cells.count() == 6 * 8 * 4
