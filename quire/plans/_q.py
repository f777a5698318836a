"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import search_terms
from quire.operators import search
from quire.sources import shelf

#: Pages of the shelf in SQL: the same numbering.
PAGES = "pg AS (SELECT source AS book, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page, doc_id, text FROM documents)"
LINES = PAGES + """,
ls AS (SELECT book, page, unnest(range(1, len(parts) + 1)) AS ln, unnest(parts) AS line FROM (SELECT book, page, string_split(text, chr(10)) AS parts FROM pg)),
ln AS (SELECT *, coalesce(lead(line) OVER (PARTITION BY book, page ORDER BY ln), '') AS next FROM ls)"""
BOOKS = "bk AS (SELECT book, max(page) AS pages FROM pg GROUP BY book)"


def norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '^the\\s+', ''), '[^a-z0-9]+', ' ', 'g'))"


def sing(x: str) -> str:
    return f"CASE WHEN {x} LIKE '%ies' THEN regexp_replace({x}, 'ies$', 'y') WHEN regexp_matches({x}, '(ch|sh|ss|x)es$') THEN regexp_replace({x}, 'es$', '') ELSE regexp_replace({x}, 's$', '') END"


def stem_list(x: str) -> str:
    return f"list_transform(list_filter(string_split({norm(x)}, ' '), lambda w: w <> ''), lambda w: {sing('w')})"


def q6(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.5) / 1000000"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.table(spark, sf_dir, "documents")


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.pages(documents(spark, sf_dir))


def book_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book").agg(F.max("page").alias("pages"))


def asked(spark: SparkSession, question: str, subject: str, name: str = "") -> DataFrame:
    """A one-question terms table."""
    one = spark.createDataFrame([(1, question, subject, name)], "qid int, question string, subject string, name string")
    return search.terms_table(one.select("qid", search_terms(F.col("question"), F.col("subject"), F.col("name")).alias("terms")))


def pieces(chars: int) -> str:
    """Pages (``pg``) cut into pieces ``pc`` (``piece`` from 1, ``text``), in a recursive query: runs up to a sentence's end, in turn; one longer than a piece loses
    pieces off its head until what is left fits."""
    return f"""{PAGES}, rn AS (SELECT doc_id, book, page, text, list_filter(string_split(regexp_replace(text, '((?:[.!?]+["'')\\]]*(?:\\s+|$)|\\n[ \\t]*\\n\\s*))', '\\1' || chr(1), 'g'), chr(1)), lambda r: r <> '') AS runs FROM pg),
st AS (SELECT doc_id, book, page, runs, 1 AS i, CASE WHEN length(text) <= {chars} THEN text ELSE '' END AS buf, CASE WHEN length(text) > {chars} THEN runs[1] END AS run, NULL::VARCHAR AS done, 0 AS n FROM rn
  UNION ALL
  SELECT doc_id, book, page, runs, CASE WHEN flush OR cut > 0 THEN i ELSE i + 1 END, CASE WHEN flush THEN '' WHEN cut > 0 THEN buf ELSE buf || run END, CASE WHEN flush THEN run WHEN cut > 0 THEN substring(run, cut + 1) ELSE runs[i + 1] END,
    CASE WHEN flush THEN buf WHEN cut > 0 THEN substring(run, 1, cut) WHEN i = len(runs) THEN buf || run END, n + 1
  FROM (SELECT *, length(buf) > 0 AND length(buf) + length(run) > {chars} AS flush,
    CASE WHEN length(run) > {chars} THEN CASE WHEN contains(substring(run, 2, {chars}), ' ') THEN {chars + 1} - position(' ' IN reverse(substring(run, 2, {chars}))) ELSE {chars} END ELSE 0 END AS cut FROM st WHERE run IS NOT NULL)),
pc AS (SELECT doc_id, book, page, text, row_number() OVER (PARTITION BY doc_id, book, page ORDER BY n) AS piece FROM (
  SELECT doc_id, book, page, done AS text, n FROM st WHERE done IS NOT NULL UNION ALL SELECT doc_id, book, page, buf, 0 FROM st WHERE n = 0 AND run IS NULL))"""
