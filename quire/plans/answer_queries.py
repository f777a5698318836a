"""Queries of ranking, walks and answer folds. Where a model would be asked, answers are *recorded*: whole hundredths
that a digest of the row gives, so that both engines read the same answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import STOPWORDS, mentions, quantised
from quire.operators import answers, decide, walk, windows
from quire.plans._q import PAGES, documents, norm, paged, pieces, q6, stem_list
from quire.plans.search_queries import question_words
from quire.sources import shelf


def recorded(*parts) -> Column:
    """0 to 100, from the parts' digest."""
    key = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("long") % 101).cast("int")


def rec(*parts: str) -> str:
    return f"CAST(CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 6) AS BIGINT) % 101 AS INTEGER)"


QUESTION = "small economy brand 7 bolt"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = shelf.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ask_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))
    asks = names.select("ask_id", "name", F.lit(QUESTION).alias("instruction"), F.col("name").alias("option"), F.lit(0).alias("pos"), F.lit("").alias("state"))
    p = decide.Lexical().answers(asks).select("ask_id", (F.col("p") * 3).alias("score"), F.greatest(F.col("p"), 1 - F.col("p")).alias("confidence"))
    return names.join(p, "ask_id")


def ranked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("ask_id", "name", quantised(F.col("score")).alias("score"), quantised(F.col("confidence")).alias("confidence"))


def top_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best names from a score of 0.6 on: score, then confidence, then input order."""
    good = ranked_names(spark, sf_dir).where("score >= 0.6")
    return good.orderBy(F.desc("score"), F.desc("confidence"), "ask_id").limit(10)


def file_order_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books in the order to read them for each language's question: recorded name scores against the best page's."""
    docs = documents(spark, sf_dir)
    page = docs.groupBy(F.col("lang").alias("qid"), F.col("source").alias("file")).agg(F.max(recorded(F.lit("page"), F.col("doc_id").cast("string")) * 3).alias("best"))
    files = page.select("qid", "file", (recorded(F.lit("name"), F.col("qid"), F.col("file")) * 3 / 100).alias("name_score"), F.when(F.col("best") % 2 == 0, F.col("best") / 100).alias("page_score"))
    return walk.file_order(files).select("qid", "file", quantised(F.col("score")).alias("score"), "rank")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question a volume of 40 pages; sections are its parts of five pages."""
    pages = paged(spark, sf_dir).select("book", "page")
    qid = F.concat_ws("/", "book", F.floor((F.col("page") - 1) / 40).cast("string"))
    section = F.floor((F.col("page") - 1) / 5).cast("int")
    key = F.col("page").cast("string")
    rows = pages.select(qid.alias("qid"), section.alias("section"), "page", (recorded("section", F.col("book"), section.cast("string")) * 3 / 100).alias("section_score"), recorded("gate", F.col("book"), key).alias("gate"), recorded("p", F.col("book"), key).alias("p"), (recorded("stated", F.col("book"), key) >= 20).alias("stated"))
    return walk.once_a_page(walk.settled(rows.where("gate >= 30"), 90))


_CAND = f"""{PAGES}, c0 AS (SELECT book || '/' || CAST((page - 1) // 40 AS VARCHAR) AS qid, CAST((page - 1) // 5 AS INTEGER) AS section, page, {rec("'section'", 'book', "CAST((page - 1) // 5 AS VARCHAR)")} * 3 / 100::DOUBLE AS section_score,
  {rec("'gate'", 'book', 'CAST(page AS VARCHAR)')} AS gate, {rec("'p'", 'book', 'CAST(page AS VARCHAR)')} AS p, {rec("'stated'", 'book', 'CAST(page AS VARCHAR)')} >= 20 AS stated FROM pg),
cd AS (SELECT *, CASE WHEN NOT stated THEN 'drop' WHEN p >= 90 THEN 'take' ELSE 'keep' END AS verdict FROM c0 WHERE gate >= 30),
st AS (SELECT *, row_number() OVER w AS step, count(*) FILTER (verdict = 'take') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS takes, count(*) FILTER (verdict = 'keep') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS keeps,
  dense_rank() OVER (PARTITION BY qid ORDER BY section_score DESC, section) AS nth FROM cd WINDOW w AS (PARTITION BY qid ORDER BY section_score DESC, section, gate DESC, page)),
sb AS (SELECT *, min(takes) OVER (PARTITION BY qid, section) AS before FROM st)"""
_WALK = "SELECT qid, CAST(step AS INTEGER) AS step, section, section_score, page, gate, p, verdict FROM sb WHERE takes < {hits} AND keeps < {kept} AND {also}"


def soft_floor_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.walk(_candidates(spark, sf_dir), hits=2, most_kept=12, floor=1.0)


def hard_floor_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.walk(_candidates(spark, sf_dir), hits=1, most_kept=8, floor=1.5, hard=True)


def budgeted_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.walk(_candidates(spark, sf_dir), hits=3, most_kept=10, most_sections=3)


def best_kept_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.best_kept(hard_floor_walk(spark, sf_dir))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells: a size is a section, a brand a window, the type's first word a style."""
    part = shelf.table(spark, sf_dir, "part")
    return part.select(F.col("p_size").alias("section"), F.col("p_brand").alias("window"), F.substring_index("p_type", " ", 1).alias("style"), F.col("p_name").alias("cell"), F.col("p_partkey").alias("pos"), recorded("cell", F.col("p_partkey").cast("string")).alias("p"))


_KEY = "regexp_replace(regexp_replace(lower(trim(cell)), '^(?:the|an?)\\s+', ''), '[\\s.,:;]+$', '')"


def _count_sql(by: str) -> str:
    return f"""ce AS (SELECT p_size AS section, p_brand AS "window", string_split(p_type, ' ')[1] AS style, p_name AS cell, p_partkey AS pos, {rec("'cell'", 'CAST(p_partkey AS VARCHAR)')} AS p FROM part),
sy AS (SELECT {by}, style, count(*) AS n, min(pos) AS first, list_sort(list(DISTINCT {_KEY})) AS names FROM ce WHERE p >= 50 GROUP BY ALL),
bs AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, first) AS k FROM sy),
su AS (SELECT {by}, count(*) FILTER (p >= 70) AS sure, count(*) FILTER (p >= 30 AND p < 70) AS doubt FROM ce GROUP BY ALL),
cn AS (SELECT {', '.join('su.' + b for b in by.split(', '))}, coalesce(names, []::VARCHAR[]) AS names, CASE WHEN names IS NULL THEN 1.0::DOUBLE ELSE sure::DOUBLE / (sure + doubt) END AS p FROM su LEFT JOIN bs ON {' AND '.join(f'su.{b} = bs.{b}' for b in by.split(', '))} AND k = 1)"""


def count_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = answers.counts(_cells(spark, sf_dir), "window")
    return out.select("window", F.size("names").alias("n"), quantised(F.col("p")).alias("p"))


def count_across_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = answers.count_across(answers.counts(_cells(spark, sf_dir), "section", "window"), "section", 0.5)
    return out.select("section", "text", quantised(F.col("p")).alias("p"))


def figure_choice_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as options for a figure (their quantity), every fourth "not stated"."""
    value = F.when(F.col("l_linenumber") % 4 == 0, F.lit("not stated")).otherwise((F.col("l_quantity") / 10).cast("int").cast("string"))
    options = shelf.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), value.alias("value"), recorded("mass", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("p"))
    return answers.figure_mass(options, "l_orderkey").select("l_orderkey", "value", F.col("mass").cast("long").alias("mass"), "row", F.col("total").cast("long").alias("total"))


def several_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as its figures: "not stated" where the recorded answer is low."""
    rows = shelf.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("name"), recorded("several", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("p"), F.col("l_quantity").cast("int").cast("string").alias("value"))
    return answers.figures_joined(rows.withColumn("value", F.when(F.col("p") < 40, F.lit("not stated")).otherwise(F.col("value"))), "l_orderkey")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = paged(spark, sf_dir)
    key = F.col("doc_id").cast("string")
    named = mentions(F.col("text"), F.col("book")) | mentions(F.col("text"), F.lit("public license"))
    text, p = answers.claim_verdict(F.col("s"), F.col("c"), F.col("k"), F.col("named"))
    rows = pages.select("book", "page", named.alias("named"), recorded("s", key).alias("s"), recorded("c", key).alias("c"), recorded("k", key).alias("k"))
    return rows.withColumns({"text": text, "p": p, "listed": F.when(F.col("named"), 0).otherwise(F.col("k"))})


_CLAIMS = f"""{PAGES}, a0 AS (SELECT book, page, (contains(' ' || {norm('text')} || ' ', ' ' || book || ' ') OR contains(' ' || {norm('text')} || ' ', ' public license ')) AS named, {rec("'s'", 'CAST(doc_id AS VARCHAR)')} AS s, {rec("'c'", 'CAST(doc_id AS VARCHAR)')} AS c, {rec("'k'", 'CAST(doc_id AS VARCHAR)')} AS k FROM pg),
a1 AS (SELECT *, CASE WHEN named THEN 0 ELSE k END AS listed FROM a0),
cv AS (SELECT *, CASE WHEN s >= 50 AND s >= c THEN 'true' WHEN c >= 50 OR listed >= 50 THEN 'false' ELSE 'not stated' END AS text,
  CASE WHEN s >= 50 AND s >= c THEN s WHEN c >= 50 OR listed >= 50 THEN greatest(c, listed) ELSE 100 - greatest(s, c, listed) END AS p FROM a1)"""


def claim_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("book", "page", "text", "p", "listed")


def grow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.grow_list(_claims(spark, sf_dir))


def passage_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each part's first page, on over pages with a recorded run."""
    pages = paged(spark, sf_dir).select("book", "page", (recorded("run", F.col("doc_id").cast("string")) >= 40).alias("has_run"))
    hits = pages.where("page % 5 = 1").select("book", "page", (F.col("page") + 4).alias("end"))
    return answers.passage_growth(pages, hits)


def name_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of passing words in benchmark texts (every fifth word read as "of")."""
    words = question_words(spark, sf_dir).withColumn("word", F.when(F.col("pos") % 5 == 3, F.lit("of")).otherwise(F.col("word")))
    passed = recorded("word", F.col("item_id").cast("string"), F.col("pos").cast("string")) >= 40
    return answers.name_runs(words.withColumn("passed", passed), "item_id").select("item_id", "pos", "name")


def gate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical decider's gate: every piece of a page of at most 1,000 characters is asked of, and a page passes by its best one, from 0.2 on."""
    asks = documents(spark, sf_dir).select("doc_id", F.posexplode(windows.pieces(F.col("text"), 1000)).alias("piece", "state"))
    asks = asks.select(F.struct("doc_id", "piece").alias("ask_id"), F.lit("yes").alias("option"), F.lit(0).alias("pos"), F.lit("this work is licensed under the public license").alias("instruction"), "state")
    best = decide.noul(decide.Lexical().answers(asks)).groupBy(F.col("ask_id.doc_id").alias("doc_id")).agg(F.max("p").alias("p"), F.count("*").alias("windows"))
    return best.where("p >= 0.2").select("doc_id", quantised(F.col("p")).alias("p"), "windows")


QUERIES = {f.__name__: f for f in (ranked_names, top_names, file_order_floor, soft_floor_walk, hard_floor_walk, budgeted_walk, best_kept_fallback, count_cells, count_across_windows, figure_choice_mass, several_figures, claim_verdict, grow_list, passage_growth, name_runs, gate_pages)}
_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
_RANKED = f"""qs AS (SELECT list_distinct({stem_list(repr(QUESTION))}) AS q), nm AS (SELECT p_partkey AS ask_id, concat_ws(' ', p_name, p_type, p_brand) AS name FROM part),
lx AS (SELECT ask_id, name, floor(len(list_intersect(q, {stem_list('name')})) * 100 / greatest(len(q), 1) + 0.5) / 100 AS p FROM nm, qs),
rn AS (SELECT ask_id, name, {q6('p * 3')} AS score, {q6('greatest(p, 1 - p)')} AS confidence FROM lx)"""
ORACLE = {
    "ranked_names": f"WITH {_RANKED} SELECT * FROM rn",
    "top_names": f"WITH {_RANKED} SELECT * FROM rn WHERE score >= 0.6 ORDER BY score DESC, confidence DESC, ask_id LIMIT 10",
    "file_order_floor": f"""WITH p AS (SELECT lang AS qid, source AS file, max({rec("'page'", 'CAST(doc_id AS VARCHAR)')} * 3) AS best FROM documents GROUP BY ALL),
f AS (SELECT qid, file, {rec("'name'", 'qid', 'file')} * 3 / 100::DOUBLE AS n, CASE WHEN best % 2 = 0 THEN best / 100::DOUBLE END AS pg FROM p),
s AS (SELECT qid, file, CASE WHEN n >= 1.5 OR pg IS NULL OR pg <= n THEN n ELSE least(pg, 1.5::DOUBLE - 0.01::DOUBLE) END AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file) AS rank FROM s) SELECT qid, file, {q6('score')} AS score, rank FROM r WHERE rank <= 5""",
    "soft_floor_walk": f"WITH {_CAND} " + _WALK.format(hits=2, kept=12, also="(section_score >= 1.0 OR before = 0)"),
    "hard_floor_walk": f"WITH {_CAND} " + _WALK.format(hits=1, kept=8, also="section_score >= 1.5"),
    "budgeted_walk": f"WITH {_CAND} " + _WALK.format(hits=3, kept=10, also="nth <= 3"),
    "best_kept_fallback": f"WITH {_CAND}, w AS ({_WALK.format(hits=1, kept=8, also='section_score >= 1.5')}), k AS (SELECT qid, page, p, row_number() OVER (PARTITION BY qid ORDER BY p DESC, step) AS k FROM w WHERE verdict = 'keep' AND qid NOT IN (SELECT qid FROM w WHERE verdict = 'take')) SELECT qid, page, p FROM k WHERE k = 1",
    "count_cells": f"""WITH {_count_sql('"window"')} SELECT "window", CAST(len(names) AS INTEGER) AS n, {q6('p')} AS p FROM cn""",
    "count_across_windows": f"""WITH {_count_sql('section, "window"')}, w AS (SELECT section, count(*) AS windows, count(*) FILTER (p >= 0.5) AS covered, min(p) FILTER (p >= 0.5 AND len(names) > 0) AS least FROM cn GROUP BY section),
u AS (SELECT section, count(DISTINCT name) AS n FROM (SELECT section, unnest(names) AS name FROM cn WHERE p >= 0.5 AND len(names) > 0) GROUP BY section)
SELECT w.section, coalesce(CAST(n AS VARCHAR), 'not stated') AS text, {q6('CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE least * (covered::DOUBLE / windows) END')} AS p FROM w LEFT JOIN u USING (section)""",
    "figure_choice_mass": f"""WITH o AS (SELECT l_orderkey, l_linenumber AS pos, CASE WHEN l_linenumber % 4 = 0 THEN 'not stated' ELSE CAST(CAST(trunc(l_quantity / 10) AS INTEGER) AS VARCHAR) END AS value, {rec("'mass'", 'CAST(l_orderkey AS VARCHAR)', 'CAST(l_linenumber AS VARCHAR)')} AS p FROM lineitem),
m AS (SELECT l_orderkey, value, CAST(sum(p) AS BIGINT) AS mass, min(pos) AS first, arg_min(pos, (100 - p) * 1000 + pos) AS row FROM o GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY mass DESC, first, value DESC) AS k, CAST(sum(mass) OVER (PARTITION BY l_orderkey) AS BIGINT) AS total FROM m) SELECT l_orderkey, value, mass, row, total FROM k WHERE k = 1""",
    "several_figures": f"""WITH o AS (SELECT l_orderkey, l_linenumber AS pos, 'line' || CAST(l_linenumber AS VARCHAR) AS name, {rec("'several'", 'CAST(l_orderkey AS VARCHAR)', 'CAST(l_linenumber AS VARCHAR)')} AS p, l_quantity FROM lineitem),
v AS (SELECT *, CASE WHEN p < 40 THEN 'not stated' ELSE CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) END AS value FROM o)
SELECT l_orderkey, CASE WHEN count(*) FILTER (value <> 'not stated') = 0 THEN 'not stated' ELSE string_agg(name || ' ' || value, ', ' ORDER BY pos, name || ' ' || value) END AS text, coalesce(min(p) FILTER (value <> 'not stated'), min(p)) AS p FROM v GROUP BY l_orderkey""",
    "claim_verdict": f"WITH {_CLAIMS} SELECT book, page, text, p, listed FROM cv",
    "grow_list": f"""WITH {_CLAIMS}, s AS (SELECT book, page AS "from" FROM cv WHERE text = 'false' AND listed >= 50), n AS (SELECT s.book, s."from", cv.page - s."from" AS d, cv.page, cv.text, cv.p, cv.listed FROM s JOIN cv ON cv.book = s.book AND cv.page <> s."from" AND abs(cv.page - s."from") <= 3),
x AS (SELECT *, NOT EXISTS (SELECT 1 FROM n m WHERE m.book = n.book AND m."from" = n."from" AND sign(m.d) = sign(n.d) AND abs(m.d) < abs(n.d) AND m.listed < 50) AS still FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY book, "from" ORDER BY d > 0, abs(d)) AS k FROM x WHERE still AND (text = 'true' OR (text = 'false' AND listed < 50))) SELECT book, "from", page, text, p FROM k WHERE k = 1""",
    "passage_growth": f"""WITH {PAGES}, r AS (SELECT book, page, {rec("'run'", 'CAST(doc_id AS VARCHAR)')} >= 40 AS has_run FROM pg), h AS (SELECT book, page AS hit FROM r WHERE page % 5 = 1),
a AS (SELECT h.book, hit, page FROM h JOIN r ON r.book = h.book AND page BETWEEN hit AND hit + 6 WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.book = h.book AND q.page > hit AND q.page <= r.page AND NOT q.has_run)) SELECT book, hit, max(page) AS last FROM a GROUP BY ALL""",
    "name_runs": f"""WITH r AS (SELECT item_id, regexp_split_to_array(trim(text), '\\s+') AS raw FROM benchmark), w AS (SELECT item_id, list_filter(list_transform(raw, lambda x: {{'word': regexp_replace(x, '[^\\w''-]', '', 'g'), 'ends': regexp_matches(x, '[,;.]$')}}), lambda s: s.word <> '') AS ws FROM r),
e AS (SELECT item_id, CAST(unnest(range(0, len(ws))) AS INTEGER) AS pos, unnest(ws) AS w FROM w),
f AS (SELECT item_id, pos, CASE WHEN pos % 5 = 3 THEN 'of' ELSE w.word END AS word, w.ends AS ends, {rec("'word'", 'CAST(item_id AS VARCHAR)', 'CAST(pos AS VARCHAR)')} >= 40 AS passed FROM e),
g AS (SELECT *, passed AND lower(word) NOT IN {_STOP} AS good FROM f),
b AS (SELECT *, good OR (lower(word) = 'of' AND coalesce(lag(good) OVER v, false) AND coalesce(lead(good) OVER v, false) AND NOT coalesce(lag(ends) OVER v, true)) AS yes FROM g WINDOW v AS (PARTITION BY item_id ORDER BY pos)),
c AS (SELECT *, yes AND (NOT coalesce(lag(yes) OVER v, false) OR coalesce(lag(ends) OVER v, true)) AS begins FROM b WINDOW v AS (PARTITION BY item_id ORDER BY pos)),
n AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY pos) AS run FROM c)
SELECT item_id, min(pos) AS pos, string_agg(word, ' ' ORDER BY pos) AS name FROM n WHERE yes GROUP BY item_id, run""",
    "gate_pages": f"""WITH RECURSIVE {pieces(1000)}, q AS (SELECT list_distinct({stem_list("'this work is licensed under the public license'")}) AS q),
l AS (SELECT doc_id, floor(len(list_intersect(q, {stem_list("'yes ' || text")})) * 100 / greatest(len(q), 1) + 0.5) / 100 AS p FROM pc, q) SELECT doc_id, {q6('max(p)')} AS p, count(*) AS windows FROM l GROUP BY doc_id HAVING max(p) >= 0.2""",
}
