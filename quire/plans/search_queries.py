"""Queries of the text search and of the text functions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import numbers
from quire.functions import text as t
from quire.operators import figures, search
from quire.plans._q import BOOKS, LINES, PAGES, asked, book_pages, documents, norm, paged, q6, stem_list
from quire.sources import shelf

QUESTION, SUBJECT = "Which public license covers this work and all rights reserved?", "public license"
_TERMS = "tm(pos, words, head, weight, subject, phrase) AS (VALUES (0, 'public license', 'public', 3, true, true), (1, 'public', 'public', 2, true, false), (2, 'license', 'license', 2, true, false), (3, 'cover', 'cover', 1, false, false), (4, 'thi', 'thi', 1, false, false), (5, 'work', 'work', 1, false, false), (6, 'all', 'all', 1, false, false), (7, 'right', 'right', 1, false, false), (8, 'reserved', 'reserved', 1, false, false))"
_HITS = f"""st AS (SELECT *, {stem_list('line')} AS own, {stem_list("line || ' ' || next")} AS joined FROM ln),
raw AS (SELECT book, page, ln, line, tm.* FROM st JOIN tm ON CASE WHEN phrase THEN contains(' ' || array_to_string(joined, ' ') || ' ', ' ' || words || ' ') ELSE list_contains(own, words) END),
cand AS (SELECT DISTINCT st.book, st.page, st.ln FROM st JOIN raw USING (book, page, ln) WHERE len(list_intersect(own, string_split(words, ' '))) > 0),
hit AS (SELECT raw.* FROM raw JOIN cand USING (book, page, ln))"""
_DF = f"""df AS (SELECT book, pos, words, weight, count(DISTINCT page) AS df FROM hit GROUP BY ALL),
wt AS (SELECT df.*, weight * ln(pages::DOUBLE / greatest(df, 1)) AS idf_weight FROM df JOIN bk USING (book))"""


def _scores(having: str) -> str:
    return f"""per AS (SELECT book, page, ln, CAST(sum(CAST(floor(idf_weight * 1000000 + 0.5) AS BIGINT)) AS BIGINT) AS micro, bool_or(subject) AS subject, count(*) AS n, min_by(head, pos) AS head, min_by(line, pos) AS line
        FROM hit JOIN wt USING (book, pos) GROUP BY book, page, ln HAVING {having}),
best AS (SELECT *, count(*) OVER (PARTITION BY book, page) AS dense, row_number() OVER (PARTITION BY book, page ORDER BY micro DESC, ln) AS k FROM per),
flat AS (SELECT *, trim(regexp_replace(regexp_replace(line, '["`\\x00-\\x1f]', '', 'g'), '\\s{{3,}}', ' | ', 'g')) AS f FROM best WHERE k = 1),
pos AS (SELECT *, CASE WHEN regexp_matches(lower(f), '(?:^|[^a-z0-9_])' || head) THEN length(regexp_extract(lower(f), '(?s)^(.*?)(?:^|[^a-z0-9_])' || head, 1)) ELSE -1 END AS seen FROM flat),
scored AS (SELECT book, page, dense, trim(substring(f, 1 + CAST(greatest(0, least(CASE WHEN seen >= 0 THEN seen - 60 ELSE 0 END, length(f) - 200)) AS BIGINT), 200)) AS content, {q6('micro::DOUBLE / 1000000 + ln(1 + dense)')} AS score FROM pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY score DESC, page) AS rank FROM scored)"""


_OUT = "SELECT book, page, content, dense, score, rank FROM ranked WHERE rank <= 20"


def _excerpts(spark: SparkSession, sf_dir: str, question=QUESTION, subject=SUBJECT, **how) -> DataFrame:
    pages = paged(spark, sf_dir)
    out = search.excerpts(shelf.lines(pages), book_pages(pages), asked(spark, question, subject), **how)
    return out.select("book", "page", "content", "dense", "score", "rank")


def shelf_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the best 20 pages of every book for a question, with their best line."""
    return _excerpts(spark, sf_dir)


def excerpt_within_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same confined to the first part of each chapter; document frequencies are still the whole book's."""
    pages = paged(spark, sf_dir)
    part = pages.where((F.col("page") - 1) % shelf.PAGES_A_CHAPTER < shelf.PAGES_A_PART).select("book", "page")
    out = search.excerpts(shelf.lines(pages), book_pages(pages), asked(spark, QUESTION, SUBJECT), within=part)
    return out.select("book", "page", "content", "dense", "score", "rank")


def excerpt_two_terms_no_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a subject a line needs two terms."""
    return _excerpts(spark, sf_dir, "Is this work licensed under a public license, version 3?", "", two_terms=True)


_TERMS2 = "tm(pos, words, head, weight, subject, phrase) AS (VALUES (0, 'thi', 'thi', 1, false, false), (1, 'work', 'work', 1, false, false), (2, 'licensed', 'licensed', 1, false, false), (3, 'under', 'under', 1, false, false), (4, 'public', 'public', 1, false, false), (5, 'license', 'license', 1, false, false), (6, 'version', 'version', 1, false, false))"


def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = paged(spark, sf_dir)
    found = search.document_frequency(search.line_hits(shelf.lines(pages), asked(spark, QUESTION, SUBJECT)))
    return search.weighted(found, book_pages(pages)).select("book", "words", "df", t.quantised(F.col("idf_weight")).alias("idf_weight"))


def phrase_over_line_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose last word and the next line's first word are joined to pairs that are seen on over one page of the book."""
    rows = shelf.lines(paged(spark, sf_dir)).where("next <> ''")
    own, after = t.stems(F.col("line")), t.stems(F.col("next"))
    pairs = rows.withColumns({"own": own, "after": after}).where("size(own) > 0 and size(after) > 0").select("book", "page", F.concat_ws(" ", F.element_at("own", -1), F.element_at("after", 1)).alias("phrase"))
    return pairs.groupBy("book", "phrase").agg(F.countDistinct("page").alias("pages")).where("pages > 1")


def normalize_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = shelf.table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("s"))
    docs = documents(spark, sf_dir).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("s"))
    both = part.unionAll(docs)
    return both.select("kind", "id", t.normalize(F.col("s")).alias("normal"), F.array_join(t.stems(F.col("s")), " ").alias("stems"))


def question_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shelf.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(t.question_words(F.col("text"))).alias("pos", "w"))
    return rows.select("item_id", "pos", "w.word", "w.ends", t.is_stopword(F.col("w.word")).alias("stopword"))


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each benchmark text read as a question: its first two words the subject, its last word the book's name."""
    words = shelf.table(spark, sf_dir, "benchmark").withColumn("w", F.split(F.trim(t.normalize(F.col("text"))), " "))
    subject, name = F.array_join(F.slice("w", 1, 2), " "), F.element_at("w", -1)
    rows = words.select("item_id", F.posexplode(t.search_terms(F.array_join("w", " "), subject, name)).alias("pos", "t"))
    return rows.select("item_id", "pos", F.col("t.words").alias("words"), F.col("t.weight").alias("weight"), F.col("t.subject").alias("subject"))


def mentions_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that mention any eight words in a row of a benchmark text, or all of a shorter one: an equi-join on windows of both, of the few lengths that occur."""

    def windows(rows: DataFrame, key: str, lengths: list[int]) -> DataFrame:
        words = rows.select(key, F.split(t.normalize(F.col("text")), " ").alias("w")).where("w[0] <> ''")

        def of(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
            return F.when(F.size("w") >= n, F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))

        cut = [of(n) for n in lengths]
        return words.select(key, F.explode(F.array_distinct(F.concat(*cut))).alias("phrase"))

    items = shelf.table(spark, sf_dir, "benchmark")
    size = F.least(F.size(F.split(t.normalize(F.col("text")), " ")), F.lit(8))
    sized = items.withColumn("n", size)
    lengths = sorted(r.n for r in sized.select("n").distinct().collect())  # at most eight
    keys = functools.reduce(DataFrame.unionByName, [windows(sized.where(F.col("n") == n), "item_id", [n]) for n in lengths])
    return windows(documents(spark, sf_dir), "doc_id", lengths).join(keys, "phrase").select("doc_id", "item_id").distinct()


def candidate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names in each book that stand on two pages or more, whatever their case."""
    rows = shelf.lines(paged(spark, sf_dir)).select("book", "page", F.explode(t.cells(F.col("line"))).alias("cell"))
    return rows.groupBy("book", F.lower("cell").alias("name")).agg(F.countDistinct("page").alias("pages"), F.min("cell").alias("cell")).where("pages > 1")


def figures_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a page in digits and words, at most three lines a value, once a line, with the words around them."""
    return figures.figures(shelf.lines(paged(spark, sf_dir)), ["book", "page"])


def figures_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts that spell their keys and day's price, a line of an order a page's line."""
    orders = shelf.table(spark, sf_dir, "orders")
    text = F.concat(F.lit("Order "), numbers.spelled(F.col("o_orderkey")), F.lit(" of v2.5:\t costs "), F.floor("o_totalprice").cast("long").cast("string"), F.lit(" caps,\nor "), F.initcap(numbers.spelled(F.floor("o_totalprice").cast("long"))), F.lit("; twice 7,000"))
    lines = orders.select(F.col("o_custkey"), "o_orderkey", F.posexplode(F.split(text, "\n")).alias("ln", "line"))
    return figures.figures(lines, ["o_custkey", "o_orderkey"], around=12)


def figure_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many figures of a page fit a call for three quantities, each with 60 characters around it."""
    rows = paged(spark, sf_dir)
    return rows.select("book", "page", t.figure_limit(F.length("text"), F.lit(3), F.lit(60)).alias("fits"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(t.chunks(F.col("text"), 6000)).alias("chunk", "part"))
    return rows.select("doc_id", "chunk", F.length("part").alias("chars"), F.md5("part").alias("digest"))


_ONES_SQL, _TENS_SQL = ("[" + ", ".join(f"'{w}'" for w in x) + "]" for x in (numbers._ONES, numbers._TENS))


def _figures(page: str, around: int) -> str:
    """Figures of ``ln`` in SQL: each match is found again behind the one before it, and a number's words are folded as (complete, run) pairs."""
    words = " ".join(f"WHEN '{w}' THEN {n}" for w, n in numbers._SMALL.items())
    scales = " ".join(f"WHEN '{w}' THEN {n}" for w, n in numbers._SCALE.items())
    return f"""fl AS (SELECT {page}, ln, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS flat FROM ln),
fm AS (SELECT {page}, ln, flat, string_split(regexp_replace(flat, '(?i)((?:^|[^A-Za-z0-9_.]))({numbers.IN_DIGITS})|\\b({numbers.IN_WORDS})\\b', '\\1' || chr(1) || '\\2\\3' || chr(2), 'g'), chr(1)) AS parts FROM fl),
fe AS (SELECT {page}, ln, flat, unnest(range(2, len(parts) + 1)) AS i, parts FROM fm WHERE len(parts) > 1),
fr AS (SELECT {page}, ln, flat, string_split(parts[i], chr(2))[1] AS raw, length(replace(array_to_string(parts[1:i - 1], ''), chr(2), '')) AS pos FROM fe),
ft AS (SELECT *, list_transform(list_filter(regexp_split_to_array(lower(raw), '[ -]+'), lambda w: w <> 'and'), lambda w: {{'t': 0::BIGINT, 'r': coalesce(CASE w {words} END, 0)::BIGINT, 's': coalesce(CASE w {scales} END, 0)::BIGINT}}) AS w FROM fr),
fz AS (SELECT *, list_reduce(w, lambda a, x: {{'t': a.t + CASE WHEN x.s >= 1000 THEN greatest(a.r, 1) * x.s ELSE 0 END, 'r': CASE WHEN x.s >= 1000 THEN 0 WHEN x.s = 100 THEN greatest(a.r, 1) * 100 ELSE a.r + x.r END, 's': 0::BIGINT}}, {{'t': 0::BIGINT, 'r': 0::BIGINT, 's': 0::BIGINT}}) AS z FROM ft),
fv AS (SELECT {page}, ln, CAST(pos AS INTEGER) AS "at", CASE WHEN regexp_matches(raw, '^\\d') THEN replace(raw, ',', '') ELSE CAST(z.t + z.r AS VARCHAR) END AS value,
  trim(substring(flat, greatest(pos - {around}, 0) + 1, least(pos, {around}) + length(raw) + {around})) AS context FROM fz),
f1 AS (SELECT * FROM fv QUALIFY row_number() OVER (PARTITION BY {page}, ln, value ORDER BY "at") = 1),
f2 AS (SELECT *, row_number() OVER (PARTITION BY {page}, value ORDER BY ln) AS k FROM f1) SELECT {page}, ln, value, "at", context FROM f2 WHERE k <= 3"""


_STOP = "(" + ", ".join(f"'{w}'" for w in t.STOPWORDS) + ")"
QUERIES = {f.__name__: f for f in (shelf_excerpts, excerpt_within_pages, excerpt_two_terms_no_subject, term_document_frequency, phrase_over_line_break, normalize_stems, question_words, search_terms, mentions_benchmark, candidate_cells, figures_in_text, figures_in_words, figure_budget, text_chunks)}
_BASE = f"WITH {LINES}, {BOOKS}"
ORACLE = {
    "shelf_excerpts": f"{_BASE}, {_TERMS}, {_HITS}, {_DF}, {_scores('bool_or(subject)')} {_OUT}",
    "excerpt_within_pages": f"{_BASE}, {_TERMS}, {_HITS}, {_DF}, {_scores('bool_or(subject) AND (page - 1) % 10 < 5')} {_OUT}",
    "excerpt_two_terms_no_subject": f"{_BASE}, {_TERMS2}, {_HITS}, {_DF}, {_scores('count(*) >= 2')} {_OUT}",
    "term_document_frequency": f"{_BASE}, {_TERMS}, {_HITS}, {_DF} SELECT book, words, df, {q6('idf_weight')} AS idf_weight FROM wt",
    "phrase_over_line_break": f"WITH {LINES}, st AS (SELECT book, page, {stem_list('line')} AS own, {stem_list('next')} AS after FROM ln WHERE next <> '') SELECT book, own[-1] || ' ' || after[1] AS phrase, count(DISTINCT page) AS pages FROM st WHERE len(own) > 0 AND len(after) > 0 GROUP BY ALL HAVING count(DISTINCT page) > 1",
    "normalize_stems": f"WITH s AS (SELECT 'part' AS kind, p_partkey AS id, p_name AS s FROM part UNION ALL SELECT 'document', doc_id, text FROM documents) SELECT kind, id, {norm('s')} AS normal, array_to_string({stem_list('s')}, ' ') AS stems FROM s",
    "question_words": f"WITH r AS (SELECT item_id, regexp_split_to_array(trim(text), '\\s+') AS raw FROM benchmark), w AS (SELECT item_id, list_filter(list_transform(raw, lambda x: {{'word': regexp_replace(x, '[^\\w''-]', '', 'g'), 'ends': regexp_matches(x, '[,;.]$')}}), lambda s: s.word <> '') AS ws FROM r), e AS (SELECT item_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS w FROM w) SELECT item_id, CAST(pos AS INTEGER) AS pos, w.word AS word, w.ends AS ends, lower(w.word) IN {_STOP} AS stopword FROM e",
    "search_terms": f"""WITH w AS (SELECT item_id, string_split({norm('text')}, ' ') AS w FROM benchmark),
s AS (SELECT item_id, {stem_list("w[-1]")} AS named, {stem_list("array_to_string(w[1:2], ' ')")} AS own, {stem_list("array_to_string(w, ' ')")} AS other FROM w),
l AS (SELECT *, list_filter(own, lambda x: NOT list_contains(named, x)) AS lft FROM s),
e AS (SELECT item_id, 0 AS grp, 0 AS i, array_to_string(lft, ' ') AS words, 3 AS weight, true AS subject FROM l WHERE len(lft) > 1
      UNION ALL SELECT item_id, 1, unnest(range(1, len(lft) + 1)), unnest(lft), 2, true FROM l
      UNION ALL SELECT item_id, 2, unnest(range(1, len(other) + 1)), unnest(other), 1, false FROM l),
f AS (SELECT e.item_id, grp, min(i) AS i, words, weight, subject FROM e JOIN l USING (item_id)
      WHERE grp < 2 OR (words NOT IN {_STOP} AND NOT list_contains(named, words) AND length(words) > 1 AND NOT list_contains(lft, words)) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY grp, i) - 1 AS INTEGER) AS pos, words, CAST(weight AS INTEGER) AS weight, subject FROM f""",
    "mentions_benchmark": f"""WITH k AS (SELECT item_id, string_split({norm('text')}, ' ') AS w FROM benchmark WHERE {norm('text')} <> ''), l AS (SELECT *, least(len(w), 8) AS n FROM k), ns AS (SELECT DISTINCT n FROM l),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM l)),
d AS (SELECT doc_id, string_split({norm('text')}, ' ') AS w FROM documents), e AS (SELECT DISTINCT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM e JOIN p USING (n, phrase)""",
    "candidate_cells": f"""WITH {LINES}, p AS (SELECT book, page, list_filter(list_transform(regexp_split_to_array(line, '{t.CELL_ENDS}'), lambda x: regexp_replace(trim(x), '^(?i:the|a|an)\\s+', '')), lambda x: regexp_matches(x, '^[A-Z]') AND length(x) <= 60 AND len(regexp_split_to_array(x, '\\s+')) <= 4) AS fit FROM ln),
b AS (SELECT book, page, unnest(list_filter(fit, lambda x, i: list_position(list_transform(fit, lambda y: lower(y)), lower(x)) = i)) AS cell FROM p)
SELECT book, lower(cell) AS name, count(DISTINCT page) AS pages, min(cell) AS cell FROM b GROUP BY book, lower(cell) HAVING count(DISTINCT page) > 1""",
    "figures_in_text": f"WITH {LINES}, {_figures('book, page', 60)}",
    "figures_in_words": f"""WITH n AS (SELECT unnest(range(0, 1000)) AS n), w AS (SELECT n, {_ONES_SQL} AS ones, {_TENS_SQL} AS tens FROM n),
s2 AS (SELECT n, ones, tens, CASE WHEN n % 100 < 20 THEN ones[n % 100 + 1] ELSE tens[n % 100 // 10 - 1] || CASE WHEN n % 10 > 0 THEN '-' || ones[n % 10 + 1] ELSE '' END END AS two FROM w),
sp AS (SELECT n, CASE WHEN n < 100 THEN two ELSE ones[n // 100 + 1] || ' hundred' || CASE WHEN n % 100 > 0 THEN ' and ' || two ELSE '' END END AS w FROM s2),
v AS (SELECT DISTINCT unnest([o_orderkey, CAST(floor(o_totalprice) AS BIGINT)]) AS v FROM orders),
sv AS (SELECT v, CASE WHEN v = 0 THEN 'zero' ELSE concat_ws(' ', CASE WHEN v >= 1000000 THEN a.w || ' million' END, CASE WHEN v // 1000 % 1000 > 0 THEN b.w || ' thousand' END, CASE WHEN v % 1000 > 0 THEN c.w END) END AS w
  FROM v JOIN sp a ON a.n = v // 1000000 JOIN sp b ON b.n = v // 1000 % 1000 JOIN sp c ON c.n = v % 1000),
tx AS (SELECT o_custkey, o_orderkey, 'Order ' || k.w || ' of v2.5:' || chr(9) || ' costs ' || CAST(p.v AS VARCHAR) || ' caps,' || chr(10) || 'or ' || array_to_string(list_transform(string_split(p.w, ' '), lambda x: upper(x[1]) || x[2:]), ' ') || '; twice 7,000' AS text
  FROM orders JOIN sv k ON k.v = o_orderkey JOIN sv p ON p.v = CAST(floor(o_totalprice) AS BIGINT)),
ln AS (SELECT o_custkey, o_orderkey, CAST(unnest(range(0, len(parts))) AS INTEGER) AS ln, unnest(parts) AS line FROM (SELECT o_custkey, o_orderkey, string_split(text, chr(10)) AS parts FROM tx)),
{_figures('o_custkey, o_orderkey', 12)}""",
    "figure_budget": f"WITH {PAGES}, o AS (SELECT book, page, length(text) AS n FROM pg) SELECT book, page, CAST(greatest(1, least(254, floor((100000 - n) / 160), floor((200000 - n) / 480))) AS BIGINT) AS fits FROM o",
    "text_chunks": "WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents), n AS (SELECT *, greatest(CAST(ceil(length(f) / 6000) AS BIGINT), 1) AS n FROM f WHERE f <> ''), e AS (SELECT *, unnest(range(0, n)) AS chunk, CAST(ceil(length(f) / n) AS BIGINT) AS size FROM n) SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(length(substring(f, chunk * size + 1, size)) AS INTEGER) AS chars, md5(substring(f, chunk * size + 1, size)) AS digest FROM e",
}
