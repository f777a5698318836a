"""Rules over two scores of labelled documents, a language a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import frontier
from quire.plans._q import documents
from quire.plans.answer_queries import rec
from quire.plans.table_queries import _labelled


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    return rows.select("lang", F.col("value").alias("a"), F.col("other").alias("b"), "good")


def rule_frontiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best bars of the AND, OR and weighted rules at three levels of precision, in each language."""
    pairs = _pairs(spark, sf_dir)
    grid = frontier.dominance(pairs, "lang")
    both, either = frontier.and_rules(grid.where("a between 40 and 100 and b between 20 and 100")), frontier.or_rules(grid.where("a between 60 and 100 and b between 70 and 100"))
    shape = ["lang", "rule", "a", "b", "taken", "tp", "margin"]
    return frontier.frontier(both.select(shape).unionByName(either.select(shape)).unionByName(frontier.sum_rules(pairs, "lang").select(shape)), "lang", (100, 95, 80))


def rule_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AND bars that English picks, in the other languages."""
    grid = frontier.dominance(_pairs(spark, sf_dir), "lang")
    rules = frontier.and_rules(grid.where("a between 40 and 100 and b between 20 and 100"))
    return frontier.carried_over(frontier.frontier(rules, "lang", (95, 80)), grid, "lang", "en")


QUERIES = {f.__name__: f for f in (rule_frontiers, rule_transfer)}

# in SQL every pair meets every bar
_ALL = f"""p AS (SELECT lang, least(100, {rec("'value'", 'CAST(doc_id AS VARCHAR)')} + quality * 15) AS a, {rec("'other'", 'CAST(doc_id AS VARCHAR)')} AS b, quality = 1 AS good FROM labels JOIN documents USING (doc_id)),
l AS (SELECT DISTINCT lang FROM p), x AS (SELECT CAST(unnest(range(0, 101)) AS INTEGER) AS v),
ra AS (SELECT l.lang, 'and' AS rule, i.v AS a, j.v AS b, count(*) FILTER (p.a >= i.v AND p.b >= j.v) AS taken, count(*) FILTER (good AND p.a >= i.v AND p.b >= j.v) AS tp,
  least(i.v - coalesce(max(p.a) FILTER (NOT good AND p.b >= j.v), -100), j.v - coalesce(max(p.b) FILTER (NOT good AND p.a >= i.v), -100)) AS margin FROM l, x i, x j JOIN p ON p.lang = l.lang WHERE i.v >= 40 AND j.v >= 20 GROUP BY l.lang, i.v, j.v)"""
_PICK = """f AS (SELECT r.*, level FROM r, (SELECT unnest({levels}) AS level) WHERE taken > 0 AND 100 * tp >= level * taken),
m AS (SELECT *, max(tp) OVER (PARTITION BY lang, rule, level) AS most FROM f),
k AS (SELECT *, count(*) OVER (PARTITION BY lang, rule, level) AS cells, row_number() OVER (PARTITION BY lang, rule, level ORDER BY margin DESC, a, b) AS k FROM m WHERE tp = most)"""
ORACLE = {
    "rule_frontiers": f"""WITH {_ALL},
ro AS (SELECT l.lang, 'or' AS rule, i.v AS a, j.v AS b, count(*) FILTER (p.a >= i.v OR p.b >= j.v) AS taken, count(*) FILTER (good AND (p.a >= i.v OR p.b >= j.v)) AS tp,
  least(i.v - coalesce(max(p.a) FILTER (NOT good AND p.b < j.v), -100), j.v - coalesce(max(p.b) FILTER (NOT good AND p.a < i.v), -100)) AS margin FROM l, x i, x j JOIN p ON p.lang = l.lang WHERE i.v >= 60 AND j.v >= 70 GROUP BY l.lang, i.v, j.v),
wv AS (SELECT lang, w, w * a + (100 - w) * b AS v, good FROM p, (SELECT CAST(unnest(range(0, 101, 5)) AS INTEGER) AS w)),
rs AS (SELECT t.lang, 'sum' AS rule, t.w AS a, t.v AS b, count(*) FILTER (q.v >= t.v) AS taken, count(*) FILTER (q.good AND q.v >= t.v) AS tp, t.v - coalesce(max(q.v) FILTER (NOT q.good), -10000) AS margin FROM (SELECT DISTINCT lang, w, v FROM wv) t JOIN wv q ON q.lang = t.lang AND q.w = t.w GROUP BY t.lang, t.w, t.v),
r AS (SELECT * FROM ra UNION ALL SELECT * FROM ro UNION ALL SELECT * FROM rs), {_PICK.format(levels='[100, 95, 80]')}
SELECT lang, rule, level, tp, taken, a, b, margin, cells FROM k WHERE k = 1""",
    "rule_transfer": f"""WITH {_ALL}, r AS (SELECT * FROM ra), {_PICK.format(levels='[95, 80]')}, bars AS (SELECT level, a, b FROM k WHERE k = 1 AND lang = 'en')
SELECT p.lang, level, bars.a, bars.b, count(*) FILTER (p.a >= bars.a AND p.b >= bars.b) AS taken, count(*) FILTER (good AND p.a >= bars.a AND p.b >= bars.b) AS tp, count(*) FILTER (good) AS good FROM p, bars WHERE p.lang <> 'en' GROUP BY ALL""",
}
