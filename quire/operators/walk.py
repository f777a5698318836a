"""The best-first walk as window predicates: a walk with early stops reads a prefix of a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order() -> tuple:
    """Sections best first, in a section the pages by their gate's value."""
    return F.desc("section_score"), F.col("section"), F.desc("gate"), F.col("page")


def settled(rows: DataFrame, floor: int = 70) -> DataFrame:
    """``verdict``: not stated drops, from ``floor`` on takes, else keeps (p in hundredths)."""
    verdict = F.when(~F.col("stated"), "drop").when(F.col("p") >= floor, "take").otherwise("keep")
    return rows.withColumn("verdict", verdict)


def once_a_page(rows: DataFrame) -> DataFrame:
    """A page answers in the first section of the walk that reaches it."""
    first = Window.partitionBy("qid", "page").orderBy(*order())
    return rows.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")


def walk(rows: DataFrame, hits: int = 1, most_kept: int = 5, floor: float | None = None, hard: bool = False, most_sections: int | None = None) -> DataFrame:
    """The rows a walk reads, with their ``step``: it ends at ``hits`` takes or ``most_kept`` keeps. Sections below ``floor``
    are read only while nothing has been taken (``hard``: never). ``most_sections`` bounds the sections read."""
    by_rank = Window.partitionBy("qid").orderBy(*order())
    ahead = by_rank.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda what, w: F.coalesce(F.sum(F.when(F.col("verdict") == what, 1).otherwise(0)).over(w), F.lit(0))
    out = rows.withColumns({"step": F.row_number().over(by_rank), "__takes": count("take", ahead), "__keeps": count("keep", ahead)})
    by_section = Window.partitionBy("qid", "section")
    out = out.withColumn("__before", F.min("__takes").over(by_section))
    if most_sections is not None:
        out = out.withColumn("__nth", F.dense_rank().over(Window.partitionBy("qid").orderBy(F.desc("section_score"), F.col("section"))))
        out = out.where(F.col("__nth") <= most_sections)
    read = (F.col("__takes") < hits) & (F.col("__keeps") < most_kept)
    if floor is not None:
        read &= (F.col("section_score") >= floor) if hard else (F.col("section_score") >= floor) | (F.col("__before") == 0)
    return out.where(read).select("qid", "step", "section", "section_score", "page", "gate", "p", "verdict")


def best_kept(rows: DataFrame) -> DataFrame:
    """The likeliest kept row of each question without a take, the first on ties."""
    taken = rows.where("verdict = 'take'").select("qid").distinct()
    kept = rows.where("verdict = 'keep'").join(taken, "qid", "left_anti")
    return kept.groupBy("qid").agg(F.max(F.struct("p", (-F.col("step")).alias("back"), "page")).alias("b")).select("qid", F.col("b.page").alias("page"), F.col("b.p").alias("p"))


def file_order(files: DataFrame, floor: float = 1.5, most: int = 5) -> DataFrame:
    """Files by name score, or by their best page's score, held under ``floor``, when that is better and the name is below it."""
    by_page = F.least(F.col("page_score"), F.lit(floor - 0.01))
    use = F.when((F.col("name_score") >= floor) | F.col("page_score").isNull() | (F.col("page_score") <= F.col("name_score")), F.col("name_score")).otherwise(by_page)
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "file")
    return files.withColumn("score", use).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= most)
