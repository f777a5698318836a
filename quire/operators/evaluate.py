"""Evaluation: closeness and case scores, regressions, precision and recall over thresholds, rule grids, bands, recall at k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def closeness(got: Column, truth: Column) -> Column:
    """1 - |got - truth| / truth, not below 0; 0 for what is no number or a truth of 0."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(got - truth), truth.cast("double"))), F.lit(0.0))


def case_scores(truth: DataFrame, got: DataFrame) -> DataFrame:
    """Score of every case; of repeated results the last holds, a missing one scores 0."""
    last = got.groupBy("case").agg(F.max_by("value", "at").alias("value"))
    return truth.join(last, "case", "left").select("case", closeness(F.col("value"), F.col("truth")).alias("score"))


def regressions(now: DataFrame, before: DataFrame, mark: float = 0.05) -> DataFrame:
    old = before.select("case", F.col("score").alias("was"))
    out = now.join(old, "case", "left").withColumn("delta", F.col("score") - F.col("was"))
    return out.withColumn("mark", F.when(F.col("delta") < -mark, "down").when(F.col("delta") > mark, "up").otherwise("same"))


def sweep(scored: DataFrame) -> DataFrame:
    """Precision, recall and F1 at each threshold (rows of a value stand or fall together). ``scored``: ``value``, ``good``."""
    groups = scored.groupBy("value").agg(F.sum(F.col("good").cast("long")).alias("g"), F.count("*").alias("n"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("value"))  # a row for each different value (quantised by the caller)
    every = Window.partitionBy(F.lit(0))
    out = groups.withColumns({"tp": F.sum("g").over(down), "taken": F.sum("n").over(down), "all_good": F.sum("g").over(every)})
    precision, recall = F.col("tp") / F.col("taken"), F.try_divide("tp", "all_good")
    return out.select("value", "g", "tp", "taken", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def average_precision(swept: DataFrame) -> DataFrame:
    """Sum over thresholds of precision times the recall gained."""
    return swept.agg(F.sum(F.col("precision") * F.col("g")).alias("s"), F.sum("g").alias("g")).select(F.try_divide("s", "g").alias("ap"))


def rule_grid(pairs: DataFrame, bars: DataFrame) -> DataFrame:
    """Right, wrong and taken pairs of the OR and AND rules at each of the ``bars`` (``a_bar``, ``b_bar``; a fixed grid).

    Pairs are first counted by the bars they clear, so that the grid meets counts, not pairs."""
    counts = pairs.groupBy("a", "b").agg(F.count_if("good").alias("good"), F.count("*").alias("n"))
    met = counts.crossJoin(bars)
    either, both = (F.col("a") >= F.col("a_bar")) | (F.col("b") >= F.col("b_bar")), (F.col("a") >= F.col("a_bar")) & (F.col("b") >= F.col("b_bar"))
    total = lambda rule, of: F.coalesce(F.sum(F.when(rule, F.col(of))), F.lit(0))
    return met.groupBy("a_bar", "b_bar").agg(total(either, "good").alias("or_good"), total(either, "n").alias("or_taken"), total(both, "good").alias("and_good"), total(both, "n").alias("and_taken"))


def bands(scored: DataFrame, bar: float, width: float) -> DataFrame:
    """Good and bad rows by the distance of their value from a bar, in bands."""
    band = F.floor((F.col("value") - bar) / width).cast("int")
    return scored.groupBy(band.alias("band")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))


def first_right(near: DataFrame) -> DataFrame:
    """The ``rank`` of each question's best right row: one more than the rows before it, counted; nothing is sorted. ``near``: ``qid``, ``o_id``, ``micro`` (higher is
    nearer, then the smaller ``o_id``), ``right``."""
    key = F.struct("micro", (-F.col("o_id")).alias("back"))
    best = near.where("right").groupBy("qid").agg(F.max(key).alias("best"))
    ahead = near.join(best, "qid").where(key > F.col("best")).groupBy("qid").agg(F.count("*").alias("ahead"))
    return best.join(ahead, "qid", "left").select("qid", (F.coalesce("ahead", F.lit(0)) + 1).alias("rank")).unionByName(near.select("qid").distinct().join(best, "qid", "left_anti").select("qid", F.lit(None).cast("long").alias("rank")))


def recall_at(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 12, 30)) -> DataFrame:
    """Share of questions whose answer ranks within each k. ``ranked``: ``qid``, ``rank`` of the first right row."""
    one = ranked.agg(*[F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")).alias(f"k{k}") for k in ks])
    return one.select(F.expr(f"stack({len(ks)}, " + ", ".join(f"{k}, k{k}" for k in ks) + ") as (k, recall)"))


def partners(rows: DataFrame, by: str) -> DataFrame:
    """How many other rows of its group each row meets."""
    return rows.join(rows.groupBy(by).agg((F.count("*") - 1).alias("partners")), by)


def modal(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group, the smaller on ties."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.max(F.struct("n", (-F.col(value)).alias("back"))).alias("b")).select(by, (-F.col("b.back")).alias(value), "b.n")


def gate_rows(gates: DataFrame, similar: DataFrame, right: DataFrame) -> DataFrame:
    """Each gated page (``book``, ``page``, ``p``) with its similarity's ``rank`` in its book, how far below the book's best it is (``rel``) and
    whether it is one of the ``right`` pages. ``similar``: ``book``, ``page``, ``micro`` (millionths of a cosine, whole).

    A rank is what ranks in higher bands of the book, then the place within the band, so that a book of most pages is many tasks' work."""
    banded = similar.withColumn("band", F.floor(F.col("micro") / 10_000))
    above = Window.partitionBy("book").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("book")
    bands_ = banded.groupBy("book", "band").agg(F.count("*").alias("n"), F.max("micro").alias("most"))
    bands_ = bands_.select("book", "band", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("ahead"), F.max("most").over(every).alias("most"))
    place = F.row_number().over(Window.partitionBy("book", "band").orderBy(F.desc("micro"), "page"))
    ranked = banded.withColumn("place", place).join(bands_, ["book", "band"]).select("book", "page", (F.col("ahead") + F.col("place")).alias("rank"), (F.col("micro") - F.col("most")).alias("rel"))
    answers = right.select("book", "page").distinct().withColumn("answer", F.lit(True))
    return gates.join(ranked, ["book", "page"]).join(answers, ["book", "page"], "left").withColumn("answer", F.coalesce("answer", F.lit(False)))


def picked_bars(counts: DataFrame, by: str, least: float) -> DataFrame:
    """For each ``by`` the bar whose precision is ``least`` or more: most good rows taken, then the highest. ``counts``: ``value``, ``g``, ``n``,
    a row a value of a group (quantised by the caller, so a group's values are few)."""
    down = Window.partitionBy(by).orderBy(F.desc("value"))
    swept = counts.groupBy(by, "value").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).withColumns({"tp": F.sum("g").over(down), "taken": F.sum("n").over(down)})
    good = swept.where(F.col("tp") >= F.col("taken") * F.lit(least))
    return good.groupBy(by).agg(F.max(F.struct("tp", "value")).alias("b")).select(by, F.col("b.value").alias("bar"))


def transfer(scored: DataFrame, by: str, origin: str, least: float) -> DataFrame:
    """The bar picked on the group ``origin``, and what it takes in every other group. ``scored``: ``value``, ``good``."""
    counts = scored.groupBy(by, "value").agg(F.count_if("good").alias("g"), F.count("*").alias("n"))
    bar = picked_bars(counts.where(F.col(by) == origin), by, least).select("bar")
    return _taken(counts.where(F.col(by) != origin).join(F.broadcast(bar), how="cross"), by)  # one bar


def refitted(scored: DataFrame, fold: str, folds: int, least: float) -> DataFrame:
    """For each of ``folds`` folds (numbered from 0) the bar picked on all other folds, and what it takes in the one held out."""
    counts = scored.groupBy(fold, "value").agg(F.count_if("good").alias("g"), F.count("*").alias("n"))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col(fold))
    bars = picked_bars(counts.withColumn("held", F.explode(others)).select(F.col("held").alias(fold), "value", "g", "n"), fold, least)
    return _taken(counts.join(bars, fold), fold)


def _taken(counts: DataFrame, by: str) -> DataFrame:
    over = F.col("value") >= F.col("bar")
    total = lambda of: F.coalesce(F.sum(F.when(over, F.col(of))), F.lit(0))
    return counts.groupBy(by, "bar").agg(total("g").alias("tp"), total("n").alias("taken"), F.sum("g").alias("good"))
