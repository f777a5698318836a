"""The shelf's record tables: books, pages, lines, sections, from any table of texts.

A book is a ``source``, its pages are its documents by id. Page numbers come from counts of blocks of ids and positions in
a block, so a book with most of the rows is still numbered by many tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGES_A_PART, PAGES_A_CHAPTER = 5, 10
BLOCK = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(rows: DataFrame, group: str, order: str, into: str, block: int = BLOCK) -> DataFrame:
    """Positions from 1 by the integer ``order`` within ``group``: block counts, their running sum, positions in the block."""
    cut = rows.withColumn("__block", F.floor(F.col(order) / F.lit(block)))
    counts = cut.groupBy(group, "__block").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy(group, "__block").orderBy(order))
    return cut.withColumn("__at", within).join(counts, [group, "__block"]).withColumn(into, (F.col("__ahead") + F.col("__at")).cast("int")).drop("__block", "__at", "__ahead")


def pages(documents: DataFrame) -> DataFrame:
    """``book``, ``page``, ``doc_id``, ``text``."""
    given = documents.select(F.col("source").alias("book"), "doc_id", "text")
    return numbered(given, "book", "doc_id", "page").select("book", "page", "doc_id", "text")


def lines(paged: DataFrame) -> DataFrame:
    """``book``, ``page``, ``ln`` (from 1), ``line`` and ``next`` (the line after it on the page, or empty)."""
    parts = F.split("text", "\n")
    out = paged.select("book", "page", parts.alias("parts")).select("book", "page", "parts", F.posexplode("parts").alias("at", "line"))
    following = F.coalesce(F.try_element_at("parts", F.col("at") + 2), F.lit(""))
    return out.select("book", "page", (F.col("at") + 1).alias("ln"), "line", following.alias("next"))


def sections(paged: DataFrame) -> DataFrame:
    """Chapters and parts over each book's pages: ``book``, ``path``, ``start``, ``end``, ``depth``."""
    sizes = paged.groupBy("book").agg(F.max("page").alias("pages"))

    def level(depth: int, size: int, path: Column) -> DataFrame:
        number = F.explode(F.sequence(F.lit(0), F.ceil(F.col("pages") / size).cast("int") - 1))
        out = sizes.select("book", "pages", number.alias("k"))
        return out.select("book", path.alias("path"), (F.col("k") * size + 1).alias("start"), F.least((F.col("k") + 1) * size, F.col("pages")).alias("end"), F.lit(depth).alias("depth"))

    chapter = lambda k: F.concat(F.col("book"), F.lit(" > chapter "), (k + 1).cast("string"))
    whole = sizes.select("book", F.col("book").alias("path"), F.lit(1).alias("start"), F.col("pages").alias("end"), F.lit(1).alias("depth"))
    ratio = PAGES_A_CHAPTER // PAGES_A_PART
    parts = level(3, PAGES_A_PART, F.concat(chapter(F.floor(F.col("k") / ratio)), F.lit(" > part "), (F.col("k") + 1).cast("string")))
    return whole.unionAll(level(2, PAGES_A_CHAPTER, chapter(F.col("k")))).unionAll(parts)


def nonempty(files: DataFrame) -> DataFrame:
    """Files with something in them (``binaryFile`` columns)."""
    return files.where("length > 0")


def listing(spark: SparkSession, folder: str, pattern: str = "*.pdf", most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Files below ``folder`` by path, the first ``most``, and a one-row table that says whether more were there."""
    # through the file system itself: Spark's own file index leaves out files of no bytes; one path more than are wanted is held, whatever the folder's size
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    found, wanted = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), jvm.org.apache.hadoop.fs.GlobPattern(pattern)

    def files() -> Iterator[tuple[str, float, int]]:
        while found.hasNext():
            file = found.next()
            if wanted.matches(file.getPath().getName()):
                yield file.getPath().toString(), file.getModificationTime() / 1000.0, file.getLen()

    rows = heapq.nsmallest(most + 1, files())
    every = spark.createDataFrame(rows[:most], "path string, modified double, length long").select("path", F.timestamp_seconds("modified").alias("modificationTime"), "length")
    return every.orderBy("path"), spark.createDataFrame([(len(rows) > most,)], "truncated boolean")


def path_list(text_rows: DataFrame) -> DataFrame:
    """One path a line, trimmed, blank lines left out."""
    return text_rows.select(F.trim("value").alias("path")).where("path <> ''")


def split_pages(files: DataFrame) -> DataFrame:
    """Pages of whole texts at form feeds, one empty page at the end dropped: ``book``, ``page``, ``text``."""
    parts = F.split("text", "\f")
    kept = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select("book", F.posexplode(kept).alias("at", "text")).select("book", (F.col("at") + 1).alias("page"), "text")
