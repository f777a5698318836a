"""Vectors by content, shortlists from them, and what a ranking cache keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import rich_text, upper
from quire.operators import store
from quire.plans._q import PAGES, documents, paged
from quire.plans.answer_queries import rec, recorded
from quire.plans.outline_queries import _SECTIONS
from quire.session import shared_folder, written
from quire.sources import shelf

CHUNK = 900


def _store(spark: SparkSession) -> store.VectorStore:
    return store.VectorStore(spark, shared_folder(spark), store.Letters())


def _asked(pages: DataFrame) -> DataFrame:
    """Every page whose id is divisible by 100 asks its book what is like it."""
    return pages.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "book", "text")


def vectors_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store embeds for the first half of the books, for all, and for all again: different chunks, once each."""
    chunks = store.page_chunks(paged(spark, sf_dir), CHUNK)
    kept = _store(spark)
    first = chunks.where(F.col("book") < "src2")
    counts = [(k, kept.fill(c)) for k, c in ((1, first), (2, chunks), (3, chunks))]
    met = chunks.select(F.lit(1).alias("k"), "text").where("false")
    for k, c in ((1, first), (2, chunks), (3, chunks)):
        met = met.unionByName(c.select(F.lit(k).alias("k"), "text"))
    sizes = met.groupBy("k").agg(F.count("*").alias("chunks"))
    return sizes.join(spark.createDataFrame(counts, "k int, embedded long"), "k")


def shortlist_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that hold a question's five best pages by stored vectors, or its excerpts' pages (here: with the longest first line)."""
    pages = written(paged(spark, sf_dir))
    asked = _asked(pages)
    similar = store.similar_pages(asked, pages, _store(spark), CHUNK, 5)
    line = F.length(F.substring_index("text", "\n", 1))
    longest = pages.groupBy("book").agg(F.max(F.struct(line.alias("n"), (-F.col("page")).alias("back"))).alias("x")).select("book", (-F.col("x.back")).alias("page"))
    excerpts = asked.select("qid", "book").join(longest, "book")
    return store.shortlist(similar, excerpts, shelf.sections(pages).where("depth = 3"), 5)


def similar_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = written(paged(spark, sf_dir))
    return store.similar_pages(_asked(pages), pages, _store(spark), CHUNK)


def cache_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as questions asked of their role's book, most of them more than once; the rankings that are kept, as they are embedded."""
    c = shelf.table(spark, sf_dir, "conversations")
    key = (F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    words = F.array_join(F.slice(F.split(F.trim("text"), "[\t\n\f\r ]+"), 1, 1), " ")
    asked = F.when(recorded("form", *key) % 2 == 0, upper(words)).otherwise(F.concat(words, F.lit(" ")))
    flag = lambda salt, bar: recorded(salt, *key) < bar
    rows = c.select(F.col("role").alias("book"), asked.alias("question"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), F.array(F.lit("a"), F.col("turn").cast("string")).alias("top"), flag("cached", 20).alias("cached"), flag("confined", 20).alias("confined"), (recorded("ranked", *key) - 10).alias("ranked"), recorded("hits", *key).alias("h")).withColumn("hits", F.floor(F.col("h") / 40))
    kept = store.stored_rankings(rows.where("at % 2 = 0 and not cached"), rows.where("at % 2 = 1"))
    return kept.select("book", "question", "at", rich_text(F.col("question"), F.col("top")).alias("rich"))


QUERIES = {f.__name__: f for f in (vectors_filled, shortlist_by_store, similar_by_store, cache_stored)}

_CHUNKS = f"""{PAGES}, fl AS (SELECT book, page, doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM pg), nn AS (SELECT *, CAST(ceil(length(f) / {CHUNK}.0) AS BIGINT) AS n FROM fl WHERE f <> ''),
ck AS (SELECT book, page, doc_id, substring(f, k * size + 1, size) AS text FROM (SELECT *, unnest(range(0, n)) AS k, CAST(ceil(length(f) / n) AS BIGINT) AS size FROM nn))"""


def _letters(x: str) -> str:
    return "[" + ", ".join(f"(length({x}) - length(replace({x}, '{chr(97 + i)}', '')))::DOUBLE" for i in range(26)) + "]"


_SIMILAR = f"""{_CHUNKS}, cv AS (SELECT book, page, {_letters('text')} AS v FROM ck), qv AS (SELECT doc_id AS qid, book, {_letters('text')} AS v FROM pg WHERE doc_id % 100 = 0),
sm AS (SELECT qid, cv.book, page, max(CASE WHEN list_sum(cv.v) > 0 AND list_sum(qv.v) > 0 THEN list_cosine_similarity(cv.v, qv.v) END) AS c FROM cv JOIN qv USING (book) GROUP BY ALL),
si AS (SELECT qv.qid, pg.book, pg.page, coalesce(CAST(floor(c * 1000000 + 0.5) AS BIGINT), -1000000) AS micro FROM pg JOIN qv USING (book) LEFT JOIN sm ON sm.qid = qv.qid AND sm.page = pg.page)"""
_FLAG = lambda salt: rec(f"'{salt}'", "CAST(conv_id AS VARCHAR)", "CAST(turn AS VARCHAR)")
ORACLE = {
    "vectors_filled": f"""WITH {_CHUNKS}, e AS (SELECT text, min(CASE WHEN book < 'src2' THEN 1 ELSE 2 END) AS k FROM ck GROUP BY text), k AS (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS k)
SELECT k.k, (SELECT count(*) FROM ck WHERE k.k > 1 OR book < 'src2') AS chunks, (SELECT count(*) FROM e WHERE e.k = k.k) AS embedded FROM k""",
    "similar_by_store": f"WITH {_SIMILAR} SELECT * FROM si",
    "shortlist_by_store": f"""WITH {_SIMILAR}, {_SECTIONS[len(PAGES) + 2 :]}, bs AS (SELECT qid, book, page FROM si QUALIFY row_number() OVER (PARTITION BY qid, book ORDER BY micro DESC, page) <= 5),
lg AS (SELECT book, page FROM pg QUALIFY row_number() OVER (PARTITION BY book ORDER BY length(string_split(text, chr(10))[1]) DESC, page) = 1),
wt AS (SELECT * FROM bs UNION SELECT qid, book, page FROM qv JOIN lg USING (book))
SELECT DISTINCT qid, sc.book, path, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end" FROM sc JOIN wt ON wt.book = sc.book AND wt.page BETWEEN start AND "end" WHERE depth = 3""",
    "cache_stored": f"""WITH r AS (SELECT role AS book, conv_id * 1000 + turn AS at_, turn, regexp_split_to_array(trim(text), '\\s+')[1] AS w, {_FLAG('form')} AS form, {_FLAG('cached')} < 20 AS cached, {_FLAG('confined')} < 20 AS confined, {_FLAG('ranked')} > 10 AS ranked, {_FLAG('hits')} >= 40 AS hits FROM conversations),
q AS (SELECT *, CASE WHEN form % 2 = 0 THEN upper(w) ELSE w || ' ' END AS question FROM r),
k AS (SELECT * FROM q WHERE NOT cached AND (at_ % 2 = 0 OR (NOT confined AND ranked AND hits)) QUALIFY row_number() OVER (PARTITION BY book, lower(trim(question)) ORDER BY at_ DESC) = 1)
SELECT book, question, at_ AS "at", question || chr(10) || 'Sections: a; ' || CAST(turn AS VARCHAR) AS rich FROM k""",
}
