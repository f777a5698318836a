"""Marked pages of reports, the reasons where nothing is marked, and the lead of a stopped run."""

from pyspark.sql import functions as F

from quire.operators import logwalk, runlog, spots
from test_logwalk import ALONE, CELLS, SHELF, rows

SHAPE = f"run int, kind string, hits array<{spots.HIT}>, table struct<rows:array<string>,columns:array<string>,cells:array<array<struct<kind:string,hit:{spots.HIT}>>>>"


def hit(page, answer="7", marks=(), section="S"):
    return ("a.pdf", section, page, answer, None if marks is None else [(p, 1, 1) for p in marks])


def test_spots(spark):
    reports = spark.createDataFrame(
        [
            (1, "count", [hit(3, marks=(5, 4, 5)), hit(8), hit(9, None), hit(2, marks=None)], None),
            (2, "truth", [hit(3), hit(4, marks=(4,))], None),
            (3, "passage", [hit(1), hit(1, "8")], None),
            (4, "table", [hit(99)], (["r", "s"], ["x", "y"], [[("count", hit(1, marks=(2,))), ("count", None)], [("truth", hit(6)), (None, hit(7))]])),
            (5, "count", [], None), (6, None, None, None),
        ],
        SHAPE,
    )
    listed = spark.createDataFrame([(3, "S", "7"), (3, "S", "7"), (2, "T", "7")], "run int, section string, text string")
    got = spots.spots(reports, listed).orderBy("run", "ord", "page").collect()
    assert [(r.run, r.key, r.page, r.cell, r.marks, r.unmarked) for r in got] == [
        (1, "h0", 4, None, 1, None), (1, "h0", 5, None, 2, None), (1, "h1", 8, None, 0, spots.UNFOUND), (1, "h2", 9, None, 0, spots.UNREAD), (1, "h3", 2, None, 0, spots.OLD),
        (2, "h0", 3, None, 0, spots.STATEMENT), (2, "h1", 4, None, 1, None), (3, "h0", 1, None, 0, spots.CONTENTS), (3, "h1", 1, None, 0, spots.UNFOUND),
        (4, "c0-0", 2, "r × x", 1, None), (4, "c1-0", 6, "s × x", 0, spots.STATEMENT), (4, "c1-1", 7, "s × y", 0, spots.UNFOUND),
    ]


def test_leads(spark):
    log = rows(spark, [SHELF, CELLS, ALONE, SHELF])
    stopped = spark.createDataFrame([(0, None), (1, None), (2, "/one.pdf")], "run int, pdf string")
    got = spots.leads(stopped, logwalk.reads(log), logwalk.files(log)).orderBy("run").collect()
    # the second run took what its contents said, which names no page
    assert [(r.run, r.pdf, r.section, r.page, r.snippet) for r in got] == [(0, "/s/Field.pdf", "Lists p.20", 20, "410"), (2, "/one.pdf", "Tools p.1 (excerpt)", 1, "7")]
    assert {r.unmarked for r in got} == {spots.STOPPED}
    assert spots.leads(stopped.where(F.lit(False)), logwalk.reads(log), logwalk.files(log)).count() == 0


def test_page_at(spark):
    tops = spark.createDataFrame([("b", 1, 0), ("b", 2, 512), ("b", 3, 9000), ("c", 1, 40)], "book string, page int, top long")
    probes = spark.createDataFrame([(i, "b", y) for i, y in enumerate([-5, 0, 511, 512, 8999, 9000, 10**9])] + [(7, "c", 3), (8, "none", 5)], "k int, book string, y long")
    for block in (7, 4096):
        assert [r.page for r in runlog.page_at(tops, probes, block).orderBy("k").collect()] == [1, 1, 1, 2, 2, 3, 3, 1, 1]


def test_percent_box(spark):
    row = spark.createDataFrame([((30.0, 50.0, 90.0, 60.0), 300.0, 400.0)], "b struct<x0:double,y0:double,x1:double,y1:double>, w double, h double")
    assert tuple(row.select(runlog.percent_box(F.col("b"), F.col("w"), F.col("h")).alias("p")).head().p) == (10.0, 12.5, 20.0, 2.5)
