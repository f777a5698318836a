"""Nearest pages and ranks among all of them, counted block by block."""

import duckdb

from quire.operators import vector
from quire.plans import table_queries
from test_meeting import ASKED, HELD, made, small_blocks  # noqa: F401


def test_rank_of_the_first_of_a_book(spark, small_blocks):
    rows = [(b, i, [x + 0.5 for x in v]) for i, (b, _, v) in enumerate(made(90, 4, 3, True))] + [(77, 200, [1.0, 0.0, 0.0, 0.0, 2.0])]
    pages = spark.createDataFrame(rows, HELD)
    got = vector.first_of_book(pages, pages.where("page % 10 = 0").withColumnRenamed("page", "qid"))
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (label INT, vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    sql = table_queries.ORACLE["recall_at_k"].replace("% 100", "% 10").split(", k AS")[0] + " SELECT vec_id, rank FROM f"
    assert sorted(map(repr, map(tuple, got.select("qid", "rank").collect()))) == sorted(map(repr, con.execute(sql).fetchall()))
    alone = pages.where("book = 77")
    assert vector.first_of_book(alone, alone.withColumnRenamed("page", "qid")).count() == 0


def test_a_ranking_gets_few_rows_of_a_block(spark, small_blocks):
    """As many of a question's pages as are asked for, a block; before, a row for each question and page."""
    rows = [(b if b else None, p, v) for b, p, v in made(600, 2, 4, False)]
    chunks, queries = spark.createDataFrame(rows, HELD), spark.createDataFrame([(1, 7, [0.3, 1.0, 0.0, 2.0, 0.1])], ASKED).drop("book")
    every, few = vector.page_similarity(chunks, queries), vector.page_similarity(chunks, queries, 1)
    assert every.count() == 300 and few.count() <= 2 * 44
    assert {(r.book, r.page, r.similarity) for r in vector.top_pages(few, 1).collect()} == {(r.book, r.page, r.similarity) for r in vector.top_pages(every, 1).collect()}
    assert {r.book for r in few.select("book").distinct().collect()} == {None, 1}
