"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is its weight's share of all words, held to ``most`` times its own words; what is over is shared out again
by weight until no source is above (water-filling in closed form: sources by the level at which they fill, prefix sums).
Within a source the expected copies of a document grow with its size: proportional to the binary digits of its number of words, held
to ``most``, and scaled so that the words expected are the target (the same water-filling, over the few size classes of a source).
The whole part of the expected copies is certain. One copy more goes to a Pareto sample: documents are ranked by the odds of a
uniform draw over the odds of their own inclusion probability (the fraction left), and taken in that order until their words come
nearest to what is missing.

The cut in the order is found from two histograms of the rank value (4096 bins, then 4096 in the bin where the cut lies) and
the few documents of the last cell, so no source is sorted in one task. The draw is a hash of the id: reruns agree. Only rows a source
and size class, and a source, stand in windows.

Defined cases: a null or blank text has size 0 and takes 0; a null source is a source and comes last; rows that share an id
share their draw (and, if of one size, enter or stay out together); ties of the rank value go by id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, written

BINS = 4096
MOST = 3


def _draw(key: Column) -> Column:
    """Uniform in (0, 1), from 52 bits of the id's MD5."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``target`` of each row of ``sources`` (``source``, ``source_size``); weights 1, 2, 3, repeating, by code point, null last."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weighted = sources.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    weighted = weighted.withColumn("most", F.lit(most) * F.col("source_size")).withColumn("fills_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("fills_at", F.col("source").isNull(), "source")
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = weighted.withColumn("level", level).withColumn("at", F.when(F.col("level") <= F.col("fills_at"), F.col("level")))
    level = F.first("at", ignorenulls=True).over(every)
    return levels.select("source", "source_size", F.least(F.col("most").cast("double"), level * F.col("weight")).alias("target"))


def chances(classes: DataFrame, most: int = MOST) -> DataFrame:
    """``whole`` copies, ``chance`` of one more, and the source's ``missing`` words, of each size class (``digits``) of each source.

    ``classes``: ``source_key``, ``digits``, ``words``, and the source's ``source_size`` and ``target``.
    """
    source = Window.partitionBy("source_key")
    order = source.orderBy(F.desc("digits"))
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(F.col("words") * F.col("digits")).over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.try_divide(F.col("target") - most * before, after.cast("double"))
    level = classes.withColumn("level", level).withColumn("at", F.when(F.col("level") * F.col("digits") <= most, F.col("level")))
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.coalesce(F.max("at").over(source), F.lit(float(most))) * F.col("digits"))).otherwise(0.0)
    whole = level.withColumn("expected", copies).withColumn("whole", F.floor("expected").cast("long")).withColumn("chance", F.col("expected") - F.col("whole"))
    return whole.withColumn("missing", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(source)).drop("level", "at", "expected", "words")


def _crossing(rows: DataFrame, bin_col: str, before: str) -> DataFrame:
    """For each source the bin in which the running words reach what is ``missing``, and the words before it."""
    sums = rows.groupBy("source_key", bin_col).agg(F.sum("size").alias("words"), F.first("missing").alias("missing"), F.first(before).alias("start"))
    run = F.col("start") + F.sum("words").over(Window.partitionBy("source_key").orderBy(bin_col))
    at = sums.withColumn("run", run).where((F.col("run") >= F.col("missing")) & (F.col("run") - F.col("words") < F.col("missing")))
    return at.select("source_key", F.col(bin_col).alias(f"cut_{bin_col}"), (F.col("run") - F.col("words")).alias(f"before_{bin_col}"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, carry: bool = False) -> DataFrame:
    """``size``, ``source_size``, ``target`` and ``copies`` of every document, and the ``chance`` and ``rank`` of its last copy; with
    ``carry``, all its columns in ``row``."""
    held = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    # one key for null and non-null sources, so that plain joins do; the prefix tells "null" from null
    key = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), key.alias("source_key"), size.alias("size"), F.length(F.bin(size)).alias("digits"), _draw(F.col(id_col)).alias("draw"), *held)
    small = written(sized.drop("row"))
    classes = written(small.groupBy("source_key", "source", "digits").agg(F.sum("size").alias("words")))
    sources = classes.groupBy("source_key", "source").agg(F.sum("words").alias("source_size"))
    shares = targets(sources, most).withColumn("source_key", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "source"))).drop("source")
    shares = written(chances(classes.drop("source").join(shares, "source_key"), most))

    def ranked(rows: DataFrame, by: DataFrame) -> DataFrame:
        odds = (F.col("draw") / (1 - F.col("draw"))) / (F.col("chance") / (1 - F.col("chance")))
        rank = F.when(F.col("chance") > 0, odds / (1 + odds))
        return rows.join(by, ["source_key", "digits"]).withColumn("rank", rank).withColumn("bin", F.floor(F.col("rank") * BINS).cast("long")).withColumn("cell", F.floor(F.col("rank") * (BINS * BINS)).cast("long"))

    sampled = ranked(small, shares.where("chance > 0")).withColumn("zero", F.lit(0).cast("long"))
    cuts = written(_crossing(sampled, "bin", "zero"))
    in_bin = sampled.join(cuts, "source_key").where(F.col("bin") == F.col("cut_bin"))
    cells = written(cuts.join(_crossing(in_bin, "cell", "before_bin"), "source_key"))
    in_cell = sampled.join(cells, "source_key").where(F.col("cell") == F.col("cut_cell"))
    groups = in_cell.groupBy("source_key", "rank", "id").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"), F.first("before_cell").alias("start"))
    upto = F.col("start") + F.sum("words").over(Window.partitionBy("source_key").orderBy("rank", "id")) - F.col("words")
    taken = groups.withColumn("upto", upto).where(F.col("upto") + F.col("words") / 2 <= F.col("missing"))
    last = taken.groupBy("source_key").agg(F.max(F.struct("rank", "id")).alias("last"))
    # a row a source and size class; as a table its size is known, so that Spark sends it to the documents where it is small
    by = written(shares.join(cells.select("source_key", "cut_cell").join(last, "source_key", "left"), "source_key", "left"))
    inside = (F.col("cell") == F.col("cut_cell")) & F.col("last").isNotNull() & (F.struct("rank", "id") <= F.col("last"))
    more = F.when((F.col("chance") > 0) & (F.col("cut_cell").isNull() | (F.col("cell") < F.col("cut_cell")) | inside), 1).otherwise(0)
    final = ranked(sized if carry else small, by).withColumn("copies", (F.col("whole") + more).cast("long"))
    return final.select(*(["row"] if carry else []), F.col("id").alias(id_col) if not carry else F.col("id").alias("__id"), "size", "source_size", "target", "copies", "chance", "rank")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST) -> DataFrame:
    """The mix itself: every document, with its columns, as often as the mix takes it."""
    taken = mix(docs, id_col, text_col, source_col, most, carry=True).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
