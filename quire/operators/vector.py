"""Vector operators: dot products and cosines in double, page similarity, top pages, and the ranking cache's lookup rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import meeting
from quire.session import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """``v`` over its length; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), size), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def page_similarity(chunks: DataFrame, queries: DataFrame, most: int | None = None) -> DataFrame:
    """The best chunk's cosine (six decimals, half up; -1 without one) of each (``qid``, ``book``, ``page``) for a stated set of ``queries`` (``qid``, ``v``), which meet every book block by
    block. With ``most`` only pages that can be among a query's ``most`` best of a book."""
    own = F.struct("book").alias("book")  # so that pages of no book meet too
    held = chunks.select(own, "page", F.col("v").cast("array<double>").alias("v"))
    asked = queries.select("qid", F.col("v").cast("array<double>").alias("v")).crossJoin(F.broadcast(held.select("book").distinct()))  # a row a book
    return meeting.similar(held, asked, most).select("qid", "book.book", "page", (F.col("micro") / 1e6).alias("similarity"))


def first_of_book(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """The ``rank`` (null: none) among all other pages, whatever their book, of the nearest page of a query's own book: one more than the pages before it, counted. A query
    (``qid``, ``book``, ``v``) is one of the ``pages`` (``page``, ``book``, ``v``); as near in millionths, the smaller number is first."""
    nearest = F.max(F.struct("micro", (-F.col("page")).alias("back"))).alias("b")
    best = meeting.similar(pages, queries, 1, but_self=True).groupBy("qid").agg(nearest).select("qid", "b.micro", (-F.col("b.back")).alias("page"))
    asked = written(queries.join(best, "qid", "left"))
    one = F.lit(0).alias("book")
    ahead = meeting.ahead(pages.select(one, "page", "v"), asked.select(one, "qid", "v", "micro", "page"))
    return ahead.where("met > 0").join(asked.select("qid", "micro"), "qid").select("qid", F.when(F.col("micro").isNotNull(), F.col("ahead") + 1).alias("rank"))


def top_pages(similar: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid", "book").orderBy(F.desc("similarity"), "page")
    return similar.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cache_lookup(asked: DataFrame, entries: DataFrame, whole: float, subject: float) -> DataFrame:
    """For each question the cached one of its book to reuse: whole similarity from ``whole`` on, or subject similarity from
    ``subject`` on; the best whole one, then the first. ``asked`` and ``entries``: ``book``, ``id``, ``rich``, ``subj``."""
    e = entries.select("book", F.col("id").alias("cached"), F.col("rich").alias("__rich"), F.col("subj").alias("__subj"))
    met = asked.join(e, "book").where("id <> cached")
    near = met.select("book", "id", "cached", cosine(F.col("rich"), F.col("__rich")).alias("whole"), cosine(F.col("subj"), F.col("__subj")).alias("part"))
    good = near.where((F.col("whole") >= whole) | (F.col("part") >= subject))
    best = good.groupBy("book", "id").agg(F.max(F.struct(F.floor(F.col("whole") * 1e6 + 0.5).alias("micro"), (-F.col("cached")).alias("back"), "part")).alias("b"))
    return best.select("book", "id", (-F.col("b.back")).alias("cached"), (F.col("b.micro") / 1e6).alias("whole"), F.col("b.part").alias("part"))
