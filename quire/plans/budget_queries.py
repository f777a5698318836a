"""Walks over files under one budget. Answers are recorded, as in the other walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import budget, walk
from quire.plans._q import PAGES, documents, paged
from quire.plans.answer_queries import rec, recorded


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions are a language's volumes of 24 pages, files are books; a chapter has 12 pages, two thirds of them in its sections of four."""
    pages = documents(spark, sf_dir).select("doc_id", "lang").join(paged(spark, sf_dir).select("doc_id", "book", "page"), "doc_id")
    chapter, part = F.floor((F.col("page") - 1) / 12).cast("string"), F.floor((F.col("page") - 1) / 4)
    section = F.concat(F.lit("c"), chapter, F.when(part % 3 > 0, F.concat(F.lit(" > s"), part.cast("string"))).otherwise(""))
    qid = F.concat_ws("/", "lang", F.floor((F.col("page") - 1) / 24).cast("string"))
    key = F.col("doc_id").cast("string")
    placed = pages.select(qid.alias("qid"), F.col("book").alias("file"), section.alias("section"), "page", recorded("gate", key).alias("gate"), recorded("p", key).alias("p"), (recorded("stated", key) >= 20).alias("stated"))
    rows = placed.withColumn("section_score", recorded("section", F.col("file"), F.col("section")) * 3 / 100).where("gate >= 40")
    rows = walk.settled(rows, 85).withColumn("whole", ~F.contains("section", F.lit(" > ")) & (recorded("whole", F.col("file"), F.col("section")) >= 50))
    files = rows.groupBy("qid", "file").agg(F.max("gate").alias("best"))
    named = files.select("qid", "file", (recorded("name", F.col("qid"), F.col("file")) * 3 / 100).alias("name_score"), F.when(F.col("best") % 2 == 0, F.col("best") * 3 / 100).alias("page_score"))
    return walk.file_order(named, most=6), rows


def shelf_budget_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three takes and eight keeps over all files of a question; files and sections below their floors while nothing was taken."""
    files, rows = _rows(spark, sf_dir)
    return budget.shelf_walk(files, rows, hits=3, most_kept=8, floor=1.5, title_floor=1.2)


def shelf_budget_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, rows = _rows(spark, sf_dir)
    return budget.shelf_walk(files, rows, hits=2, most_kept=5, floor=1.5, hard=True)


def shelf_budget_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files opened, with what each had left of both budgets and where it stopped."""
    files, rows = _rows(spark, sf_dir)
    walked = budget.steps(rows)
    return budget.allotted(files, budget.summaries(walked, 3, 6), 3, 6, 1.5).select("qid", "file", "rank", "hits_left", "keeps_left", "stop")


QUERIES = {f.__name__: f for f in (shelf_budget_soft, shelf_budget_hard, shelf_budget_files)}

# in SQL the files of a question stand one after the other and one running count over all of them is the budget
_ROWS = f"""{PAGES}, d0 AS (SELECT pg.book AS file, pg.page, pg.doc_id, lang || '/' || CAST((page - 1) // 24 AS VARCHAR) AS qid, 'c' || CAST((page - 1) // 12 AS VARCHAR) || CASE WHEN (page - 1) // 4 % 3 > 0 THEN ' > s' || CAST((page - 1) // 4 AS VARCHAR) ELSE '' END AS section
  FROM pg JOIN documents USING (doc_id)),
d1 AS (SELECT *, {rec("'gate'", 'CAST(doc_id AS VARCHAR)')} AS gate, {rec("'p'", 'CAST(doc_id AS VARCHAR)')} AS p, {rec("'stated'", 'CAST(doc_id AS VARCHAR)')} >= 20 AS stated, {rec("'section'", 'file', 'section')} * 3 / 100::DOUBLE AS section_score,
  NOT contains(section, ' > ') AND {rec("'whole'", 'file', 'section')} >= 50 AS whole FROM d0),
d2 AS (SELECT *, CASE WHEN NOT stated THEN 'drop' WHEN p >= 85 THEN 'take' ELSE 'keep' END AS verdict FROM d1 WHERE gate >= 40),
f0 AS (SELECT qid, file, {rec("'name'", 'qid', 'file')} * 3 / 100::DOUBLE AS n, CASE WHEN max(gate) % 2 = 0 THEN max(gate) * 3 / 100::DOUBLE END AS pg FROM d2 GROUP BY ALL),
f1 AS (SELECT qid, file, CASE WHEN n >= 1.5 OR pg IS NULL OR pg <= n THEN n ELSE least(pg, 1.5::DOUBLE - 0.01::DOUBLE) END AS score FROM f0),
fs AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file) AS rank FROM f1 QUALIFY rank <= 6),
d3 AS (SELECT * FROM d2 QUALIFY NOT whole OR row_number() OVER (PARTITION BY qid, file, section ORDER BY gate DESC, page) = 1),
d4 AS (SELECT *, row_number() OVER (PARTITION BY qid, file ORDER BY section_score DESC, section, gate DESC, page) AS step FROM d3),
d5 AS (SELECT a.*, b.step AS counted FROM d4 a LEFT JOIN d4 b ON a.qid = b.qid AND a.file = b.file AND b.whole AND a.section LIKE b.section || ' > %'),
d6 AS (SELECT *, CASE WHEN verdict = 'keep' THEN counted END AS moved FROM d5 WHERE counted IS NULL OR counted > step),
w0 AS (SELECT *, count(*) FILTER (verdict = 'take') OVER (PARTITION BY qid, file ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t0 FROM d6),
w1 AS (SELECT *, min(t0) OVER (PARTITION BY qid, file, section) AS at_section FROM w0),
w2 AS (SELECT w1.*, fs.rank, fs.score FROM w1 JOIN fs USING (qid, file) {{titles}}),
mv AS (SELECT qid, file, moved AS step, count(*) AS back FROM w2 WHERE moved IS NOT NULL GROUP BY ALL),
w3 AS (SELECT w2.*, CASE verdict WHEN 'take' THEN 1 ELSE 0 END AS t, CASE verdict WHEN 'keep' THEN 1 ELSE 0 END - coalesce(back, 0) AS k FROM w2 LEFT JOIN mv USING (qid, file, step)),
w4 AS (SELECT *, CAST(coalesce(sum(t) OVER w, 0) AS BIGINT) AS takes, CAST(coalesce(sum(k) OVER w, 0) AS BIGINT) AS keeps FROM w3 WINDOW w AS (PARTITION BY qid ORDER BY rank, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w5 AS (SELECT *, first_value(takes) OVER v AS file_takes, first_value(keeps) OVER v AS file_keeps, max(takes) OVER r AS worst_t, max(keeps) OVER r AS worst_k FROM w4
  WINDOW v AS (PARTITION BY qid, file ORDER BY step), r AS (PARTITION BY qid ORDER BY rank, step)),
rd AS (SELECT * FROM w5 WHERE worst_t < {{hits}} AND worst_k < {{kept}} AND (score >= 1.5 OR {{below}}))"""
_READ = "SELECT qid, CAST(rank AS INTEGER) AS rank, file, CAST(step AS INTEGER) AS step, section, page, p, CASE WHEN moved <= max(step) OVER (PARTITION BY qid, file) THEN 'drop' ELSE verdict END AS outcome, coalesce(moved <= max(step) OVER (PARTITION BY qid, file), false) AS fragment FROM rd"
ORACLE = {
    "shelf_budget_soft": f"WITH {_ROWS.format(titles='WHERE section_score >= 1.2 OR at_section = 0', hits=3, kept=8, below='file_takes = 0')} {_READ}",
    "shelf_budget_hard": f"WITH {_ROWS.format(titles='', hits=2, kept=5, below='false')} {_READ}",
    "shelf_budget_files": f"WITH {_ROWS.format(titles='', hits=3, kept=6, below='file_takes = 0')} SELECT qid, file, CAST(rank AS INTEGER) AS rank, 3 - min(file_takes) AS hits_left, 6 - min(file_keeps) AS keeps_left, CAST(max(step) AS INTEGER) AS stop FROM rd GROUP BY ALL",
}
