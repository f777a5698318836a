"""The figures that a text states, in digits or words: the options of a question for a number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.numbers import figure_parts, figure_value


def figures(lines: DataFrame, page: list[str], around: int = 60, rows_a_value: int = 3) -> DataFrame:
    """``ln``, ``value``, ``at`` (in the line, its white space single) and ``context`` (``around`` characters on either side) of every figure.

    A figure that a line repeats is its first; one that more lines of a page repeat is an option up to ``rows_a_value`` times, since only the row
    around it tells them apart. ``lines`` has the ``page`` columns, ``ln`` and ``line``. One shuffle, by page; a long line is cut at its figures once, and
    a context is put together from at most ``around`` neighbours on either side. A number in words beyond 64 bits is no figure.
    """
    cut = lines.select(*page, "ln", figure_parts(F.col("line")).alias("parts")).where("size(parts) > 1").repartition(*page)
    near = F.struct(
        F.transform("parts", lambda p: p["text"]).alias("texts"),
        F.col("parts"),
    )
    held = cut.select(*page, "ln", F.explode(F.array(near)).alias("n"))
    pick = F.transform(F.col("n.parts"), lambda p, i: F.struct(
        p["raw"].alias("raw"), F.length(p["text"]).alias("size"),
        F.array_join(F.slice(F.col("n.texts"), F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around))), "").alias("before"),
        F.array_join(F.slice(F.col("n.texts"), i + 1, F.lit(around + 1)), "").alias("after"),
    ))
    rows = held.select(*page, "ln", F.posexplode(pick).alias("i", "f"))
    line = Window.partitionBy(*page, "ln").orderBy("i")
    at = F.sum("f.size").over(line) - F.col("f.size")
    # the whole line's ends are trimmed as the line is; what is cut off inside is trimmed here
    context = F.trim(F.concat(F.expr(f"right(f.before, {around})"), F.substring(F.col("f.after"), F.lit(1), F.length("f.raw") + around)))
    found = rows.select(*page, "ln", at.cast("int").alias("at"), figure_value(F.col("f.raw")).alias("value"), context.alias("context")).where("value is not null")
    once = found.withColumn("k", F.row_number().over(Window.partitionBy(*page, "ln", "value").orderBy("at"))).where("k = 1")
    by_value = Window.partitionBy(*page, "value").orderBy("ln")
    return once.withColumn("k", F.row_number().over(by_value)).where(F.col("k") <= rows_a_value).select(*page, "ln", "value", "at", "context")
