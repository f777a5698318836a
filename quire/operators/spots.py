"""Marked pages of a run's report: nested hits and cells unfolded to a row a page, with the reason where nothing is marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Why a hit has nothing marked on its page; the first that applies.
OLD = "this run was saved before highlights were kept with each run"
CONTENTS = "read off the table of contents; the page shown is where the section starts"
STATEMENT = "a statement rests on no single line, so nothing is marked"
UNREAD = "this page passed the gate; nothing was read off it"
UNFOUND = "the answer's text was not found on the page's lines"
STOPPED = "the run was stopped before this was weighed, so nothing is marked"

HIT = "struct<pdf:string,section:string,page:int,answer:string,marks:array<struct<page:int,x:int,y:int>>>"


def unmarked(hit: Column, kind: Column, contents: Column) -> Column:
    """The reason, or null where the hit has marks."""
    return (
        F.when(hit["marks"].isNull(), OLD).when(F.size(hit["marks"]) > 0, F.lit(None).cast("string")).when(contents, CONTENTS)
        .when(kind == "truth", STATEMENT).when(hit["answer"].isNull(), UNREAD).otherwise(UNFOUND)
    )


def _hits(reports: DataFrame) -> DataFrame:
    """A row a hit: those of a table's cells, row by row, where the report has a table, else those of the report."""
    plain = reports.where("table is null").select("run", "kind", F.posexplode("hits").alias("i", "hit"))
    plain = plain.select("run", "kind", F.concat(F.lit("h"), F.col("i").cast("string")).alias("key"), F.lit(None).cast("string").alias("cell"), F.struct("i", F.lit(0).alias("j")).alias("ord"), "hit")
    rows = reports.where("table is not null").select("run", "table", F.posexplode("table.cells").alias("i", "row"))
    cells = rows.select("run", "table", "i", F.posexplode("row").alias("j", "c")).where("c.hit is not null")
    name = F.concat(F.get("table.rows", F.col("i")), F.lit(" × "), F.get("table.columns", F.col("j")))
    key = F.concat(F.lit("c"), F.col("i").cast("string"), F.lit("-"), F.col("j").cast("string"))
    return plain.unionByName(cells.select("run", F.col("c.kind").alias("kind"), key.alias("key"), name.alias("cell"), F.struct("i", "j").alias("ord"), F.col("c.hit").alias("hit")))


def spots(reports: DataFrame, listed: DataFrame) -> DataFrame:
    """Every page that a run's answers stand on, in the order of its answers (``nth``): its ``marks`` there, or why it has none (``unmarked``).

    ``reports``: ``run``, ``kind``, ``hits`` (an array of ``HIT``) and ``table`` (null, or its ``rows``, ``columns`` and ``cells``, an array a row of ``kind`` and ``hit``). ``listed``: what
    the contents answered (``run``, ``section``, ``text``); a hit with such an answer was never read off a page. A hit's arrays stay whole only as long as its own row.
    """
    said = listed.groupBy("run", "section", "text").agg(F.lit(True).alias("contents"))
    hits = _hits(reports).withColumns({"section": F.col("hit.section"), "text": F.col("hit.answer")})
    met = hits.join(said, ["run", "section", "text"], "left").withColumn("contents", F.coalesce("contents", F.lit(False)))
    why = unmarked(F.col("hit"), F.coalesce("kind", F.lit("")), F.col("contents"))
    pages = F.when(F.col("why").isNotNull(), F.array("hit.page")).otherwise(F.array_sort(F.array_distinct(F.transform("hit.marks", lambda m: m["page"]))))
    each = met.withColumn("why", why).withColumn("page", F.explode(pages))
    own = F.when(F.col("why").isNull(), F.size(F.filter("hit.marks", lambda m: m["page"] == F.col("page")))).otherwise(0)
    return each.select("run", "ord", "key", "hit.pdf", "section", "page", "cell", own.alias("marks"), F.col("why").alias("unmarked"))


def leads(stopped: DataFrame, reads: DataFrame, files: DataFrame) -> DataFrame:
    """What each of the ``stopped`` runs (``run``, ``pdf``: the file of a run without a shelf) had taken last, where it names a page: never weighed, so nothing is marked."""
    took = reads.where("verdict = 'take'").join(files.where("left is null").select("run", "file", "path"), ["run", "file"])
    last = took.join(stopped, "run").groupBy("run").agg(F.max(F.struct("read", F.coalesce("path", "pdf").alias("pdf"), "page", "name", "answer")).alias("r"))
    good = last.where("r.pdf is not null and r.page is not null")
    return good.select("run", F.lit("lead").alias("key"), "r.pdf", F.col("r.name").alias("section"), "r.page", F.col("r.answer").alias("snippet"), F.lit(STOPPED).alias("unmarked"))
