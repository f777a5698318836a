"""Tables of parts filled in stages. What each stage finds is recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import stages
from quire.plans.answer_queries import rec, recorded
from quire.sources import shelf


class Recorded:
    """Sources whose answers digests give: a column's by table and column, a cell's by row and column."""

    @staticmethod
    def _column(columns: DataFrame, salt: str, bar: int) -> DataFrame:
        found = columns.where(recorded(salt, F.col("tid"), F.col("column")) >= bar)
        return found.select("tid", "j", F.lit(salt).alias("table"), F.col("j").alias("col"))

    @staticmethod
    def _cell(cells: DataFrame, salt: Column | str, bar: int) -> DataFrame:
        n = recorded(salt if isinstance(salt, Column) else F.lit(salt), F.col("i").cast("string"), F.col("column"))
        return cells.select(*stages.CELL, F.when(n >= bar, F.concat_ws(" ", salt if isinstance(salt, Column) else F.lit(salt), n.cast("string"))).alias("text"))

    def own_columns(self, columns: DataFrame) -> DataFrame:
        return self._column(columns, "own", 60)

    def labels(self, columns: DataFrame) -> DataFrame:
        return self._column(columns, "label", 70).withColumnRenamed("table", "label")

    def entries(self, cells: DataFrame) -> DataFrame:
        return self._cell(cells, "entry", 40)

    def derived(self, cells: DataFrame) -> DataFrame:
        return self._cell(cells, "derived", 50).where("text is not null")

    def searched(self, columns: DataFrame) -> DataFrame:
        return self._column(columns, "search", 50)

    def pooled(self, columns: DataFrame) -> DataFrame:
        return self._column(columns, "pool", 50)

    def table_cells(self, cells: DataFrame) -> DataFrame:
        return self._cell(cells, F.col("table"), 30)

    def beside(self, cells: DataFrame) -> DataFrame:
        return cells.select(*stages.CELL, F.concat("text", F.lit(" (beside)")).alias("text"))


def _composed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = shelf.table(spark, sf_dir, "part")
    rows = part.select(F.col("p_brand").alias("tid"), F.col("p_partkey").alias("i"), F.col("p_name").alias("name"))
    names = F.array(*[F.lit(x) for x in ("cost", "weight", "range", "damage", "ammo")])
    columns = part.select(F.col("p_brand").alias("tid")).distinct().select("tid", F.posexplode(names).alias("j", "column"))
    return stages.compose(rows, columns, Recorded(), columns.where("column = 'ammo'"))


def composed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composed(spark, sf_dir)[0]


def composed_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many columns or cells each stage was asked about, by table."""
    return _composed(spark, sf_dir)[1].select("tid", "stage", "asked")


QUERIES = {f.__name__: f for f in (composed_cells, composed_asks)}


def _n(salt: str) -> str:
    return rec(salt, "CAST(i AS VARCHAR)", '"column"')


# in SQL a column's source is one CASE, and a cell's text another
_CELLS = f"""gr AS (SELECT p_brand AS tid, p_partkey AS i, p_name AS name, CAST(j AS INTEGER) AS j, c AS "column" FROM part, (SELECT unnest(range(0, 5)) AS j, unnest(['cost', 'weight', 'range', 'damage', 'ammo']) AS c)),
cs AS (SELECT DISTINCT tid, j, "column", {rec("'own'", 'tid', '"column"')} >= 60 AS own, {rec("'label'", 'tid', '"column"')} >= 70 AS label, {rec("'search'", 'tid', '"column"')} >= 50 AS search, {rec("'pool'", 'tid', '"column"')} >= 50 AS pool FROM gr),
dv AS (SELECT gr.*, own, label, search, pool, {_n("'derived'")} >= 50 AS derived FROM gr JOIN cs USING (tid, j, "column")),
ms AS (SELECT *, count(*) FILTER (derived) OVER (PARTITION BY tid, j) >= greatest(least(count(*) OVER (PARTITION BY tid, j), 2)::DOUBLE, count(*) OVER (PARTITION BY tid, j) * 0.5::DOUBLE) AS most FROM dv),
sr AS (SELECT *, CASE WHEN own THEN 'own' WHEN label THEN 'label' WHEN most THEN 'derived' WHEN search THEN 'search' WHEN pool THEN 'pool' ELSE 'none' END AS src FROM ms),
tx AS (SELECT *, CASE WHEN src IN ('own', 'search', 'pool') AND {_n('src')} >= 30 THEN src || ' ' || CAST({_n('src')} AS VARCHAR) WHEN src = 'label' AND {_n("'entry'")} >= 40 THEN 'entry ' || CAST({_n("'entry'")} AS VARCHAR)
  WHEN derived THEN 'derived ' || CAST({_n("'derived'")} AS VARCHAR) END AS text FROM sr)"""
ORACLE = {
    "composed_cells": f"""WITH {_CELLS} SELECT tid, i, j, name, "column", text || CASE WHEN "column" = 'ammo' THEN ' (beside)' ELSE '' END AS text,
  CASE WHEN text LIKE 'derived%' THEN CASE WHEN src IN ('own', 'label') THEN 'gaps' ELSE 'own cells' END WHEN text LIKE 'own%' THEN 'own table' WHEN text LIKE 'entry%' THEN 'entries' WHEN text IS NOT NULL THEN 'searches' END AS stage FROM tx""",
    "composed_asks": f"""WITH {_CELLS}, co AS (SELECT DISTINCT tid, j, src FROM tx), un AS (
  SELECT tid, 'own table' AS stage FROM co UNION ALL SELECT tid, 'own table cells' FROM tx WHERE src = 'own' UNION ALL SELECT tid, 'entries' FROM co WHERE src <> 'own' UNION ALL SELECT tid, 'entries cells' FROM tx WHERE src = 'label'
  UNION ALL SELECT tid, 'own cells' FROM tx WHERE src NOT IN ('own', 'label') UNION ALL SELECT tid, 'searches' FROM co WHERE src IN ('search', 'pool', 'none') UNION ALL SELECT tid, 'other tables' FROM co WHERE src IN ('pool', 'none')
  UNION ALL SELECT tid, 'searches cells' FROM tx WHERE src IN ('search', 'pool') UNION ALL SELECT tid, 'gaps' FROM tx WHERE src IN ('own', 'label') AND (text IS NULL OR text LIKE 'derived%') UNION ALL SELECT tid, 'annotation' FROM tx WHERE "column" = 'ammo' AND text IS NOT NULL)
SELECT tid, stage, count(*) AS asked FROM un GROUP BY ALL""",
}
