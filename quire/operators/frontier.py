"""Rules over two scores: every bar pair at once from dominance sums, with margins to the nearest wrong pair.

Scores are whole hundredths from 0 to 100, so pairs are first counted by cell, and all that a rule needs are cumulative sums and running maxima over a grid of 101 by 101
cells a group: any bar is then a lookup. No pair meets a bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP, NO_WRONG = 100, -100
LEVELS = (100, 95, 90)


def _cells(pairs: DataFrame, by: str) -> DataFrame:
    """A row for each cell of each group's grid: ``n`` pairs, ``g`` good ones."""
    counts = pairs.groupBy(by, "a", "b").agg(F.count("*").alias("n"), F.count_if("good").alias("g"))
    grid = counts.select(by).distinct().withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(TOP)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(TOP))))
    return grid.join(counts, [by, "a", "b"], "left").select(by, "a", "b", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("g", F.lit(0)).alias("g"))


def dominance(pairs: DataFrame, by: str) -> DataFrame:
    """For bars (``a``, ``b``) of each group: pairs at or over both (``both``, ``both_good``), pairs under both (``under``, ``under_good``), all (``every``, ``every_good``), and of the
    wrong pairs the largest first score at or over ``b`` and under it (``a_over``, ``a_under``), and the largest second at or over ``a`` and under it; ``NO_WRONG`` without one.

    ``pairs``: the group, ``a``, ``b``, ``good``."""
    cells = _cells(pairs, by)
    up = lambda key, along: Window.partitionBy(by, key).orderBy(F.desc(along)).rowsBetween(Window.unboundedPreceding, 0)
    down = lambda key, along: Window.partitionBy(by, key).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    rows = cells
    for c in ("n", "g"):
        rows = rows.withColumns({f"{c}_up": F.sum(c).over(up("a", "b")), f"{c}_down": F.coalesce(F.sum(c).over(down("a", "b")), F.lit(0))})
    wrong = F.col("n") > F.col("g")
    rows = rows.withColumns({"wa": F.max(F.when(wrong, F.col("a"))).over(Window.partitionBy(by, "b")), "wb": F.max(F.when(wrong, F.col("b"))).over(Window.partitionBy(by, "a"))})
    # one more pass along the other score
    out = rows.withColumns({
        "both": F.sum("n_up").over(up("b", "a")), "both_good": F.sum("g_up").over(up("b", "a")),
        "under": F.coalesce(F.sum("n_down").over(down("b", "a")), F.lit(0)), "under_good": F.coalesce(F.sum("g_down").over(down("b", "a")), F.lit(0)),
        "b_over": F.max("wb").over(up("b", "a")), "b_under": F.max("wb").over(down("b", "a")),
        "a_over": F.max("wa").over(up("a", "b")), "a_under": F.max("wa").over(down("a", "b")),
    })
    every = cells.groupBy(by).agg(F.sum("n").alias("every"), F.sum("g").alias("every_good"))
    held = [F.coalesce(c, F.lit(NO_WRONG)).alias(c) for c in ("a_over", "a_under", "b_over", "b_under")]
    return out.join(every, by).select(by, "a", "b", "both", "both_good", "under", "under_good", "every", "every_good", *held)


def and_rules(grid: DataFrame) -> DataFrame:
    """Both scores at their bars: how far either bar can drop before a wrong pair gets in is the ``margin``."""
    margin = F.least(F.col("a") - F.col("a_over"), F.col("b") - F.col("b_over"))
    return grid.select("*", F.lit("and").alias("rule"), F.col("both").alias("taken"), F.col("both_good").alias("tp"), margin.alias("margin"))


def or_rules(grid: DataFrame) -> DataFrame:
    margin = F.least(F.col("a") - F.col("a_under"), F.col("b") - F.col("b_under"))
    return grid.select("*", F.lit("or").alias("rule"), (F.col("every") - F.col("under")).alias("taken"), (F.col("every_good") - F.col("under_good")).alias("tp"), margin.alias("margin"))


def sum_rules(pairs: DataFrame, by: str, step: int = 5) -> DataFrame:
    """``a`` hundredths of the first score and the rest of the second, from ``b`` (ten-thousandths) on, for every ``step``: each value that occurs is a bar."""
    counts = pairs.groupBy(by, "a", "b").agg(F.count("*").alias("n"), F.count_if("good").alias("g"))
    weighted = counts.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(step))))
    values = weighted.groupBy(by, "w", (F.col("w") * F.col("a") + (100 - F.col("w")) * F.col("b")).alias("v")).agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    up = Window.partitionBy(by, "w").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    worst = F.max(F.when(F.col("n") > F.col("g"), F.col("v"))).over(Window.partitionBy(by, "w"))
    rows = values.select(by, F.col("w").alias("a"), F.col("v").alias("b"), F.sum("n").over(up).alias("taken"), F.sum("g").over(up).alias("tp"), (F.col("v") - F.coalesce(worst, F.lit(100 * NO_WRONG))).alias("margin"))
    return rows.withColumn("rule", F.lit("sum"))


def frontier(rules: DataFrame, by: str, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """For each group, rule and level of precision (in hundredths) the bars that take most good pairs, of those with the widest ``margin``, then the lowest; and how many ``cells`` take as many."""
    fit = rules.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).where((F.col("taken") > 0) & (100 * F.col("tp") >= F.col("level") * F.col("taken")))
    most = fit.groupBy(by, "rule", "level").agg(F.max("tp").alias("tp"))
    best = fit.join(most, [by, "rule", "level", "tp"])
    first = F.min(F.struct((-F.col("margin")).alias("m"), "a", "b", "taken")).alias("x")
    return best.groupBy(by, "rule", "level", "tp").agg(first, F.count("*").alias("cells")).select(by, "rule", "level", "tp", "x.taken", "x.a", "x.b", (-F.col("x.m")).alias("margin"), "cells")


def carried_over(picked: DataFrame, grid: DataFrame, by: str, origin: str) -> DataFrame:
    """The ``and`` bars that the group ``origin`` picked, at each level, in every other group: what they take there, by lookup."""
    bars = picked.where((F.col(by) == origin) & (F.col("rule") == "and")).select("level", "a", "b")
    return grid.where(F.col(by) != origin).join(bars, ["a", "b"]).select(by, "level", "a", "b", F.col("both").alias("taken"), F.col("both_good").alias("tp"), F.col("every_good").alias("good"))
