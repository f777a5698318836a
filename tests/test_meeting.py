"""Questions against all rows of their book, block by block: every pair, in SQL's millionths, and no more rows than a ranking needs."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import meeting, store
from quire.session import shared_folder

HELD, ASKED = "book int, page long, v array<double>", "book int, qid long, v array<double>"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(meeting, "VECTORS", 7)
    monkeypatch.setattr(meeting, "QUESTIONS", 3)


def made(n, books, seed, whole):
    """``n`` vectors of five, two a page, some of them equal, some zero."""
    r = np.random.default_rng(seed)
    v = r.integers(0, 4, (n, 5)).astype(float) if whole else r.normal(size=(n, 5)).round(1)
    v[::9] = v[0]
    v[::11] = 0
    return [(int(i) % books, int(i) // books // 2, x.tolist()) for i, x in enumerate(v)]


def of_sql(held, asked):
    con = duckdb.connect()
    con.execute("CREATE TABLE h (book INT, page BIGINT, v DOUBLE[]); CREATE TABLE a (book INT, qid BIGINT, v DOUBLE[])")
    con.executemany("INSERT INTO h VALUES (?, ?, ?)", held)
    con.executemany("INSERT INTO a VALUES (?, ?, ?)", asked)
    zero = "list_sum(list_transform({}, lambda x: abs(x))) = 0"
    c = f"CASE WHEN h.v IS NULL OR a.v IS NULL OR {zero.format('h.v')} OR {zero.format('a.v')} THEN NULL ELSE list_cosine_similarity(h.v, a.v) END"
    return con.execute(f"SELECT qid, book, page, coalesce(floor(max({c}) * 1000000 + 0.5)::BIGINT, -1000000) FROM h JOIN a USING (book) GROUP BY ALL").fetchall()


@pytest.mark.parametrize("whole", [True, False])
def test_every_pair_as_in_sql(spark, small_blocks, whole):
    held = [*made(120, 3, 1, whole), (1, 500, None), (2, 0, None), (5, 1, [1.0] * 5)]
    asked = [*[(b, 100 * i + b, v) for i, (b, _, v) in enumerate(made(30, 3, 2, whole))], (1, 9999, None), (4, 8888, [1.0] * 5)]
    h, a = spark.createDataFrame(held, HELD), spark.createDataFrame(asked, ASKED)
    want = of_sql(held, asked)
    every = [tuple(r) for r in meeting.similar(h, a).select("qid", "book", "page", "micro").collect()]
    assert sorted(every) == sorted(want)
    few = [tuple(r) for r in meeting.similar(h, a, 2).select("qid", "book", "page", "micro").collect()]
    best = lambda rows: {q: sorted((-m, p) for i, _, p, m in rows if i == q)[:2] for q in {r[0] for r in rows}}
    assert best(few) == best(want) and len(few) < len(want)


def test_an_edge_of_a_millionth(spark):
    """Cosines of k / 128 lie between two millionths; the length's two roots multiplied, as before, fall on the other side of some."""
    b = np.random.default_rng(5).integers(0, 60, (400_000, 8)).astype(float)
    a = np.array([1.0, 1.0, 0, 0, 0, 0, 0, 0])
    on = np.nonzero(((b * b).sum(axis=1) == 8192) & (b @ a % 2 == 1))[0]
    dot = b[on] @ a
    assert len(on) and (np.floor(dot / 128 * 1e6 + 0.5) != np.floor(dot / (np.sqrt(2.0) * np.sqrt(8192.0)) * 1e6 + 0.5)).any()
    held = [(int(i), 1, a.tolist()) for i in on]
    asked = [(int(i), int(i), b[i].tolist()) for i in on]
    got = meeting.similar(spark.createDataFrame(held, HELD), spark.createDataFrame(asked, ASKED)).select("qid", "book", "page", "micro")
    assert sorted(map(tuple, got.collect())) == sorted(of_sql(held, asked))


def test_a_shortlist_asks_for_its_pages_only(spark, small_blocks):
    pages = spark.createDataFrame([("b", p, "abcdefgh"[p % 8 :] * (1 + p % 5)) for p in range(1, 200)], "book string, page int, text string")
    asked = spark.createDataFrame([(100, "b", "aabc")], "qid long, book string, text string")
    kept = store.VectorStore(spark, shared_folder(spark), store.Letters())
    every, few = store.similar_pages(asked, pages, kept), store.similar_pages(asked, pages, kept, most=1)
    sections = pages.select("book", F.concat(F.lit("s"), F.col("page").cast("string")).alias("path"), F.col("page").alias("start"), F.col("page").alias("end"))
    none = asked.select("qid", "book", F.lit(0).alias("page")).where("false")
    assert every.count() == 199 and few.count() < 120
    assert store.shortlist(few, none, sections, 1).collect() == store.shortlist(every, none, sections, 1).collect()
