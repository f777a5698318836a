"""Folds of decided answers: counts, figures, claims, passages. Probabilities are whole hundredths unless named otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import STOPWORDS

YES, SURE, DOUBT = 50, 70, 30


def name_key(name: Column, counted: str = "") -> Column:
    """Lower case without an article before, punctuation after, or the kind that is ``counted`` (its last word, or the singular of it)."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"^(?:the|an?)\s+", ""), r"[\s.,:;]+$", "")
    if not counted.split():
        return bare
    kind = counted.split()[-1].lower()
    one = re.sub("ies$", "y", kind) if kind.endswith("ies") else re.sub("es$", "", kind) if re.search("(ch|sh|ss|x)es$", kind) else re.sub("s$", "", kind)
    return F.regexp_replace(bare, rf"\s+(?:{re.escape(one)}|{re.escape(kind)})$", "")


def counts(cells: DataFrame, *by: str, counted: str = "") -> DataFrame:
    """``names`` (their number) and ``p`` of each window: different names among the yeses in the style that most yeses have
    (the first seen on ties); p is the sure answers' share of sure and doubtful ones. No names: not stated, p 1."""
    styled = cells.where(F.col("p") >= YES).groupBy(*by, "style").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.array_sort(F.collect_set(name_key(F.col("cell"), counted))).alias("names"))
    listed = styled.groupBy(*by).agg(F.max(F.struct("n", (-F.col("first")).alias("back"), "names")).alias("b"))
    sure = cells.groupBy(*by).agg(F.count_if(F.col("p") >= SURE).alias("sure"), F.count_if((F.col("p") >= DOUBT) & (F.col("p") < SURE)).alias("doubt"))
    out = sure.join(listed, list(by), "left")
    names = F.coalesce(F.col("b.names"), F.array().cast("array<string>"))
    return out.select(*by, names.alias("names"), F.when(F.size(names) == 0, 1.0).otherwise(F.try_divide("sure", F.col("sure") + F.col("doubt"))).alias("p"))


def count_across(windows: DataFrame, by: str, floor: float) -> DataFrame:
    """One count over a section's windows: the union of names of windows from ``floor`` on; p is the least of those that name
    any, times the share of windows from ``floor`` on."""
    counted = F.col("p") >= floor
    naming = counted & (F.size("names") > 0)
    out = windows.groupBy(by).agg(F.count("*").alias("windows"), F.count_if(counted).alias("covered"), F.min(F.when(naming, F.col("p"))).alias("least"))
    union = windows.where(naming).select(by, F.explode("names").alias("name")).groupBy(by).agg(F.countDistinct("name").alias("n"))
    out = out.join(union, by, "left")
    return out.select(by, F.coalesce(F.col("n").cast("string"), F.lit("not stated")).alias("text"), F.when(F.col("n").isNull(), 1.0).otherwise(F.col("least") * (F.col("covered") / F.col("windows"))).alias("p"))


def figure_mass(options: DataFrame, *by: str) -> DataFrame:
    """The value whose options hold most probability (its first option's place on ties), and its likeliest option."""
    mass = options.groupBy(*by, "value").agg(F.sum("p").alias("mass"), F.min("pos").alias("first"), F.max(F.struct("p", (-F.col("pos")).alias("back"))).alias("row"))
    best = mass.groupBy(*by).agg(F.max(F.struct("mass", (-F.col("first")).alias("back"), "value", "row")).alias("b"), F.sum("mass").alias("total"))
    return best.select(*by, F.col("b.value").alias("value"), F.col("b.mass").alias("mass"), (-F.col("b.row.back")).alias("row"), "total")


def figures_joined(parts: DataFrame, by: str) -> DataFrame:
    """Several figures as one answer: "name value" in order, p the least of the stated ones; all unstated refuse."""
    stated = F.col("value") != "not stated"
    out = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", "name", "value").alias("t")))).alias("t"), F.min(F.when(stated, F.col("p"))).alias("stated"), F.min("p").alias("least"))
    return out.select(by, F.when(F.col("stated").isNull(), F.lit("not stated")).otherwise(F.array_join(F.transform("t", lambda x: x["t"]), ", ")).alias("text"), F.coalesce("stated", "least").alias("p"))


def claim_verdict(stated: Column, contradicted: Column, listed: Column, named: Column) -> tuple[Column, Column]:
    """Verdict and p of a claim on a page: a list speaks against it only where the name is not on the page."""
    against = F.when(named, 0).otherwise(listed)
    true, false = (stated >= 50) & (stated >= contradicted), (contradicted >= 50) | (against >= 50)
    text = F.when(true, "true").when(false, "false").otherwise("not stated")
    p = F.when(true, stated).when(false, F.greatest(contradicted, against)).otherwise(100 - F.greatest(stated, contradicted, against))
    return text, p


def grow_list(pages: DataFrame, reach: int = 3) -> DataFrame:
    """For pages whose "false" rests on a list: the nearest decisive page, up to ``reach`` before and then after, as long as
    every page between still lists (``listed`` >= 50). ``pages``: ``book``, ``page``, ``text``, ``p``, ``listed``."""
    starts = pages.where("text = 'false' and listed >= 50").select("book", F.col("page").alias("from"))
    steps = F.array(*[F.lit(d) for d in [*range(-1, -reach - 1, -1), *range(1, reach + 1)]])
    near = starts.withColumn("d", F.explode(steps)).withColumn("page", F.col("from") + F.col("d")).join(pages, ["book", "page"])
    side = Window.partitionBy("book", "from", F.signum("d")).orderBy(F.abs("d"))
    still = F.coalesce(F.min(F.when(F.col("listed") >= 50, 1).otherwise(0)).over(side.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    reached = F.count("*").over(side) == F.abs("d")
    decisive = near.withColumns({"still": still, "reached": reached}).where("still = 1 and reached and (text = 'true' or (text = 'false' and listed < 50))")
    best = decisive.groupBy("book", "from").agg(F.min(F.struct((F.col("d") > 0).alias("after"), F.abs("d").alias("far"), "page", "text", "p")).alias("b"))
    return best.select("book", "from", F.col("b.page").alias("page"), F.col("b.text").alias("text"), F.col("b.p").alias("p"))


def passage_growth(pages: DataFrame, hits: DataFrame, past: int = 2) -> DataFrame:
    """The last page of each hit's passage: on from its page while each next page has a run of its own, at most ``past``
    pages beyond the section's end. ``hits``: ``book``, ``page``, ``end``."""
    ahead = hits.select("book", F.col("page").alias("hit"), F.explode(F.sequence(F.col("page"), F.col("end") + past)).alias("page")).join(pages, ["book", "page"])
    w = Window.partitionBy("book", "hit").orderBy("page")
    on = F.min(F.when((F.col("page") == F.col("hit")) | F.col("has_run"), 1).otherwise(0)).over(w)
    return ahead.withColumn("on", on).where("on = 1").groupBy("book", "hit").agg(F.max("page").alias("last"))


def name_runs(words: DataFrame, *by: str) -> DataFrame:
    """Runs of words that ``passed`` and are no stopwords, ended by a word that ``ends``; an "of" between two such joins them."""
    w = Window.partitionBy(*by).orderBy("pos")
    good = F.col("passed") & ~F.lower("word").isin(*STOPWORDS)
    rows = words.withColumn("good", good)
    bridge = (F.lower("word") == "of") & F.lag("good", 1, False).over(w) & F.lead("good", 1, False).over(w) & ~F.lag("ends", 1, True).over(w)
    rows = rows.withColumn("yes", F.col("good") | bridge)
    begins = F.col("yes") & (~F.lag("yes", 1, False).over(w) | F.lag("ends", 1, True).over(w))
    rows = rows.withColumn("run", F.sum(F.when(begins, 1).otherwise(0)).over(w)).where("yes")
    return rows.groupBy(*by, "run").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("name"))
