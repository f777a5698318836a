"""Outline operators over sections (``book``, ``path``, ``start``, ``end``, ``depth``): ranges, families, pools, narrowest cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import mentions, singular

SEPARATOR = " > "
#: Pages to a key when page ranges meet pages; a range is one row for each key it touches.
KEY_PAGES = 8


def depth_of(path: Column) -> Column:
    return F.size(F.split(path, SEPARATOR))


def parent_of(path: Column) -> Column:
    """The path above, or null at the top."""
    return F.when(F.contains(path, F.lit(SEPARATOR)), F.regexp_extract(path, "^(.*) > ", 1))


def ancestors(path: Column) -> Column:
    """All paths above ``path``, top first."""
    parts = F.split(path, SEPARATOR)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), SEPARATOR))).otherwise(F.array().cast("array<string>"))


def ranges(entries: DataFrame, pages: DataFrame, most_depth: int) -> DataFrame:
    """``end`` of bookmarks in preorder (``book``, ``pos``, ``path``, ``depth``, ``start``, null where unresolved): the page
    before the next entry at the same depth or above, stretched over what lies under it; the book's ``pages`` if none follows.
    Unresolved entries still end others' ranges (as unknown, so the last page holds) and are then left out."""
    under = entries.select("book", F.explode(ancestors(F.col("path"))).alias("path"), F.col("start").alias("inner")).groupBy("book", "path").agg(F.max("inner").alias("inner"))
    order = Window.partitionBy("book").orderBy("pos")
    levels = None
    for d in range(1, most_depth + 1):  # one lead over the entries that can end a section of depth d
        own = entries.where(F.col("depth") <= d).withColumns({"next": F.lead("start").over(order), "follows": F.lead("pos").over(order).isNotNull()}).where(F.col("depth") == d)
        levels = own if levels is None else levels.unionAll(own)
    out = levels.where("start is not null").join(under, ["book", "path"], "left").join(pages, "book")
    end = F.greatest("start", F.coalesce("inner", "start"), F.when(F.col("next").isNotNull(), F.col("next") - 1).otherwise(F.col("pages")))
    return out.select("book", "pos", "path", "depth", "start", end.alias("end"))


def children(paths: DataFrame) -> DataFrame:
    """``parent``, the number of its ``children`` and their names in order."""
    own = paths.withColumns({"parent": parent_of(F.col("path")), "name": F.element_at(F.split("path", SEPARATOR), -1)}).where("parent is not null")
    return own.groupBy("book", "parent").agg(F.count("*").alias("children"), F.array_join(F.sort_array(F.collect_list("name")), "; ").alias("names"))


def under(sections: DataFrame, best: DataFrame) -> DataFrame:
    """Sections below one of the ``best`` paths (``book``, ``path``): an equi-join on every path above a section."""
    above = sections.withColumn("__above", F.explode(ancestors(F.col("path"))))
    keys = best.select("book", F.col("path").alias("__above")).distinct()
    return above.join(keys, ["book", "__above"], "left_semi").drop("__above").distinct()


def _keyed(sections: DataFrame) -> DataFrame:
    return sections.withColumn("__key", F.explode(F.sequence(F.floor(F.col("start") / KEY_PAGES), F.floor(F.col("end") / KEY_PAGES))))


def holding(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections that hold one of ``pages`` (``book``, ``page``): a range join on shared page keys."""
    wanted = pages.select(F.col("book").alias("__book"), F.col("page").alias("__page"), F.floor(F.col("page") / KEY_PAGES).alias("__at")).distinct()
    on = (F.col("book") == F.col("__book")) & (F.col("__key") == F.col("__at")) & F.col("__page").between(F.col("start"), F.col("end"))
    return _keyed(sections).join(wanted, on, "left_semi").drop("__key").distinct()


def narrowest(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """The narrowest section over each page; of equally narrow ones the deeper, then the first by path."""
    spans = _keyed(sections).select(F.col("book").alias("__book"), "path", "start", "end", "depth", "__key")
    at = pages.withColumn("__at", F.floor(F.col("page") / KEY_PAGES))
    met = at.join(spans, (F.col("book") == F.col("__book")) & (F.col("__key") == F.col("__at")) & F.col("page").between(F.col("start"), F.col("end")))
    best = met.groupBy("book", "page").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("width"), (-F.col("depth")).alias("up"), "path", "start", "end")).alias("s"))
    return best.select("book", "page", "s.path", "s.start", "s.end")


def confine(sections: DataFrame, parents: DataFrame) -> DataFrame:
    """For each of ``parents`` (``book``, ``parent``): itself, what is under it, and the opening of the chapter above it."""
    lineage = F.concat(F.array("path"), ancestors(F.col("path")))
    pool = sections.withColumn("parent", F.explode(lineage)).join(parents, ["book", "parent"]).select("book", "parent", "path", "start", "end")
    above = parents.withColumn("above", parent_of(F.col("parent"))).where("above is not null")
    first = sections.withColumn("above", F.explode(ancestors(F.col("path")))).groupBy("book", "above").agg(F.min("start").alias("first"))
    chapter = sections.select("book", F.col("path").alias("above"), "start")
    opening = above.join(chapter, ["book", "above"]).join(first, ["book", "above"]).where("first > start")
    return pool.unionAll(opening.select("book", "parent", F.concat("above", F.lit(" (opening)")).alias("path"), "start", (F.col("first") - 1).alias("end")))


def groups(paths: DataFrame) -> DataFrame:
    """For each parent how many ``kids`` its entries list, the ``most`` kids that one of those has, and how many of them ``branch`` (have any)."""
    own = paths.select("book", "path", parent_of(F.col("path")).alias("parent"))
    sizes = own.where("parent is not null").groupBy("book", "parent").agg(F.count("*").alias("kids"))
    below = sizes.select("book", F.col("parent").alias("path"), F.col("kids").alias("inner"))
    met = own.where("parent is not null").join(below, ["book", "path"], "left")
    return met.groupBy("book", "parent").agg(F.count("*").alias("kids"), F.coalesce(F.max("inner"), F.lit(0)).alias("most"), F.count("inner").alias("branch"))


def counted(paths: DataFrame, picks: DataFrame, floor: int = 70) -> DataFrame:
    """What the contents say to questions for a number: a count (``text``, ``p``), or only the ``parent`` whose pages are to be read.

    ``paths``: ``book``, ``path``. ``picks``: ``qid``, ``book``, ``parent`` (the group whose entries seem to be the things asked for), ``p``, ``grouped`` (how
    sure the entries are kinds of the things, not the things) and ``counted`` (the things). A pick below ``floor``, or of a group of fewer than two, says nothing.
    Bookmarks are a count only while they are the list:

    - entries that are kinds of the things, or one with more entries below it than the group has, send to the group's pages;
    - a group that itself stands among fewer childless entries, in a section named after the things, is that section's list swallowed by its first
      entry: the section's pages are read.

    Guards are counts of entries by parent, met twice by path: no subtree is listed. A path that occurs twice counts twice.
    """
    g = groups(paths)
    copies = paths.groupBy("book", F.col("path").alias("parent")).agg(F.count("*").alias("copies"))
    at = picks.where(F.col("p") >= floor).join(g, ["book", "parent"]).where("kids > 1").withColumn("above", parent_of(F.col("parent")))
    upper = g.select("book", F.col("parent").alias("above"), F.col("kids").alias("beside"), F.col("branch").alias("branches"))
    met = at.join(upper, ["book", "above"], "left").join(copies, ["book", "parent"], "left")
    word = F.element_at(F.split(F.coalesce("counted", F.lit("")), r"\s+"), -1)
    name = F.element_at(F.split("above", SEPARATOR), -1)
    about = (word == "") | mentions(name, word) | mentions(name, singular(word))
    siblings = F.coalesce(F.col("beside") - F.coalesce("copies", F.lit(0)), F.lit(0))
    leaves = F.col("branches") <= F.coalesce("copies", F.lit(0))
    swallowed = (siblings > 0) & (siblings < F.col("kids")) & leaves & about
    pages = (F.col("grouped") >= 50) | (F.col("most") > F.col("kids"))
    answer = ~pages & ~F.coalesce(swallowed, F.lit(False))
    parent = F.when(~pages & F.coalesce(swallowed, F.lit(False)), F.col("above")).otherwise(F.col("parent"))
    return met.select("qid", "book", parent.alias("parent"), F.when(answer, F.col("kids").cast("string")).alias("text"), F.when(answer, F.col("p")).alias("p"))
