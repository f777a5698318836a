"""Weighted text search over a shelf: lines against terms, document frequencies, best line and density a page, top pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import excerpt, quantised, stems


def terms_table(terms: DataFrame) -> DataFrame:
    """``qid``, ``pos``, ``words``, ``weight``, ``subject`` from a column ``terms`` of arrays of these."""
    out = terms.select("qid", F.posexplode("terms").alias("pos", "t")).select("qid", "pos", "t.*")
    return out.withColumn("head", F.substring_index("words", " ", 1)).withColumn("phrase", F.contains("words", F.lit(" ")))


#: Up to so many terms are sent to every task; a larger table of questions is joined by a shuffle.
MOST_SENT = 50_000


def line_hits(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """Lines that hold a term: a word in the line itself, a phrase in the line joined with the next one.

    An equi-join of the lines' different stems with the terms' first words; the rest of a phrase is checked on the match.
    A line without any term word of its own is no candidate, however the next line goes on.
    """
    own, joined = stems(F.col("line")), stems(F.concat_ws(" ", "line", "next"))
    read = lines.withColumns({"own": own, "joined": joined}).withColumn("head", F.explode(F.array_distinct("joined")))
    small = terms.limit(MOST_SENT + 1).count() <= MOST_SENT
    hit = read.join(F.broadcast(terms) if small else terms.hint("merge"), "head")
    held = F.when(F.col("phrase"), F.contains(F.concat(F.lit(" "), F.array_join("joined", " "), F.lit(" ")), F.concat(F.lit(" "), F.col("words"), F.lit(" ")))).otherwise(F.array_contains("own", F.col("head")))
    term = F.struct("pos", "words", "head", "weight", "subject", F.size(F.array_intersect("own", F.split("words", " "))).alias("own_words"))
    by_line = hit.where(held).groupBy("qid", "book", "page", "ln").agg(F.first("line").alias("line"), F.collect_list(term).alias("found"))
    return by_line.where(F.exists("found", lambda t: t["own_words"] > 0)).withColumn("t", F.explode("found")).select("qid", "book", "page", "ln", "line", "t.*")


def document_frequency(hits: DataFrame) -> DataFrame:
    """Pages of each book that hold each term: ``df``."""
    return hits.groupBy("qid", "book", "pos", "words", "weight").agg(F.countDistinct("page").alias("df"))


def weighted(frequencies: DataFrame, book_pages: DataFrame) -> DataFrame:
    """``idf_weight``: weight * ln(pages / max(df, 1)); zero for a term on every page."""
    return frequencies.join(book_pages, "book").withColumn("idf_weight", F.col("weight") * F.ln(F.col("pages") / F.greatest("df", F.lit(1))))


def page_scores(hits: DataFrame, weights: DataFrame, within: DataFrame | None = None, two_terms: bool = False) -> DataFrame:
    """Best line and score of each page. A line counts if it holds a subject term (with ``two_terms``, two of any).

    ``within`` (``book``, ``page``) confines the pages looked at; the weights stay those of the whole book.
    """
    looked = hits if within is None else hits.join(within, ["book", "page"], "left_semi")
    scored = looked.join(weights.select("qid", "book", "pos", "idf_weight"), ["qid", "book", "pos"])
    by_line = scored.groupBy("qid", "book", "page", "ln").agg(
        F.sum(F.floor(F.col("idf_weight") * 1e6 + 0.5).cast("long")).alias("micro"), F.max("subject").alias("subject"), F.count("*").alias("n"),
        F.min_by(F.struct("head", "line"), "pos").alias("first"))
    good = by_line.where("n >= 2" if two_terms else "subject")
    best = good.groupBy("qid", "book", "page").agg(F.max_by("first", F.struct("micro", -F.col("ln"))).alias("first"), F.max("micro").alias("micro"), F.count("*").alias("dense"))
    return best.select("qid", "book", "page", excerpt(F.col("first.line"), F.col("first.head")).alias("content"), "dense", quantised(F.col("micro") / 1e6 + F.log1p("dense")).alias("score"))


def excerpts(lines: DataFrame, book_pages: DataFrame, terms: DataFrame, limit: int = 20, within: DataFrame | None = None, two_terms: bool = False) -> DataFrame:
    """The ``limit`` best pages of each book for each question, with their best line: one plan over the whole shelf."""
    hits = line_hits(lines, terms)
    found = page_scores(hits, weighted(document_frequency(hits), book_pages), within, two_terms)
    order = Window.partitionBy("qid", "book").orderBy(F.desc("score"), "page")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
