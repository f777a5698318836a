"""Marked pages of reports made from orders: their lines are hits, or the cells of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import logwalk, spots
from quire.plans.answer_queries import recorded
from quire.plans.log_queries import _log
from quire.sources import shelf


def _reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: shelf.table(spark, sf_dir, n)
    text = lambda c: F.col(c).cast("string")
    q, at = F.col("l_quantity").cast("int"), (F.col("l_linenumber") * 3).cast("int")
    mark = lambda off, x: F.struct((at + off).alias("page"), (q + x).alias("x"), F.col("l_linenumber").cast("int").alias("y"))
    marks = F.when(F.col("l_orderkey") % 7 == 0, None).when(q % 4 == 0, F.array().cast("array<struct<page:int,x:int,y:int>>")).when(q % 4 == 1, F.array(mark(2, 0), mark(0, 1), mark(2, 2))).otherwise(F.array(mark(1, 0)))
    hit = F.struct(F.concat(F.lit("s"), text("l_suppkey")).alias("pdf"), F.concat(F.lit("part "), (F.col("l_partkey") % 9).cast("string")).alias("section"), at.alias("page"), F.when(q % 5 > 0, (q % 6).cast("string")).alias("answer"), marks.alias("marks"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", q.alias("q"), hit.alias("hit"))
    kinds = F.array(*[F.lit(x) for x in ("truth", "count", "passage")])
    orders = t("orders").select(F.col("o_orderkey").alias("run"), F.get(kinds, (F.col("o_orderkey") % 3).cast("int")).alias("kind"), (F.col("o_orderkey") % 5 == 2).alias("tabled"))
    cell = F.struct(F.get(kinds, (F.col("l_partkey") % 3).cast("int")).alias("kind"), F.when(F.col("l_partkey") % 4 > 0, F.col("hit")).alias("hit"))
    met = orders.join(lines, F.col("run") == F.col("l_orderkey"))
    held = met.groupBy("run", "kind", "tabled").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "q", "hit", cell.alias("cell")))).alias("x"))
    cells = F.transform("x", lambda r: F.array(r["cell"]))
    names = F.transform("x", lambda r: F.concat(F.lit("row "), r["l_linenumber"].cast("string")))
    table = F.when(F.col("tabled"), F.struct(names.alias("rows"), F.array(F.lit("value")).alias("columns"), cells.alias("cells")))
    reports = held.select("run", "kind", F.transform("x", lambda r: r["hit"]).alias("hits"), table.alias("table"))
    listed = t("orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("run"), F.concat(F.lit("part "), (F.col("o_custkey") % 9).cast("string")).alias("section"), (F.col("o_custkey") % 6).cast("string").alias("text"))
    return reports, listed


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.spots(*_reports(spark, sf_dir)).select("run", "key", "pdf", "section", "page", "cell", "marks", "unmarked")


def stopped_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two in three of the logged runs, as if they had been stopped."""
    log = _log(spark, sf_dir)
    stopped = log.select("run").distinct().where(recorded("stop", F.col("run").cast("string")) >= 33).withColumn("pdf", F.lit("/one.pdf"))
    return spots.leads(stopped, logwalk.reads(log), logwalk.files(log))


QUERIES = {f.__name__: f for f in (marked_pages, stopped_leads)}
ORACLE = {
    "marked_pages": f"""WITH l AS (SELECT l_orderkey AS run, l_linenumber AS n, 's' || CAST(l_suppkey AS VARCHAR) AS pdf, 'part ' || CAST(l_partkey % 9 AS VARCHAR) AS section, CAST(l_linenumber * 3 AS INTEGER) AS at_, CAST(trunc(l_quantity) AS INTEGER) AS q, l_partkey, l_suppkey FROM lineitem),
h AS (SELECT *, run % 5 = 2 AS tabled, row_number() OVER (PARTITION BY run ORDER BY n, l_suppkey, l_partkey, q) - 1 AS i, CASE WHEN q % 5 > 0 THEN CAST(q % 6 AS VARCHAR) END AS answer,
  CASE WHEN run % 5 = 2 THEN ['truth', 'count', 'passage'][l_partkey % 3 + 1] ELSE ['truth', 'count', 'passage'][run % 3 + 1] END AS kind FROM l WHERE run IN (SELECT o_orderkey FROM orders)),
w AS (SELECT h.*, CASE WHEN run % 7 = 0 THEN '{spots.OLD}' WHEN q % 4 > 0 THEN NULL
  WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderkey = run AND o_orderkey % 2 = 0 AND 'part ' || CAST(o_custkey % 9 AS VARCHAR) = section AND CAST(o_custkey % 6 AS VARCHAR) = answer) THEN '{spots.CONTENTS}'
  WHEN kind = 'truth' THEN '{spots.STATEMENT}' WHEN answer IS NULL THEN '{spots.UNREAD}' ELSE '{spots.UNFOUND.replace(chr(39), chr(39) * 2)}' END AS unmarked FROM h WHERE NOT tabled OR l_partkey % 4 > 0),
p AS (SELECT *, unnest(CASE WHEN unmarked IS NOT NULL THEN [at_] WHEN q % 4 = 1 THEN [at_, at_ + 2] ELSE [at_ + 1] END) AS page FROM w)
SELECT run, CASE WHEN tabled THEN 'c' || CAST(i AS VARCHAR) || '-0' ELSE 'h' || CAST(i AS VARCHAR) END AS key, pdf, section, page, CASE WHEN tabled THEN 'row ' || CAST(n AS VARCHAR) || ' × value' END AS cell,
  CAST(CASE WHEN unmarked IS NOT NULL THEN 0 WHEN q % 4 = 1 AND page = at_ + 2 THEN 2 ELSE 1 END AS INTEGER) AS marks, unmarked FROM p""",
}
