"""Queries of names, cached questions, choices by table, and studies of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import decide, evaluate, runlog, tables, vector
from quire.plans import answer_queries
from quire.plans._q import PAGES, documents, norm, paged, sing
from quire.plans.answer_queries import rec, recorded
from quire.plans.table_queries import _LOG, _log
from quire.sources import shelf


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shelf.table(spark, sf_dir, name)


def _s(c: str):
    return F.col(c).cast("string")


def bare_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names with leaders, notes and punctuation behind them, and without."""
    tail = F.element_at(F.array(F.lit(" ......12"), F.lit(" (x2)"), F.lit(":"), F.lit(" (a) (b).")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", text.bare(F.concat("p_name", tail)).alias("name"))


def cached_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of a user with the same words, for each turn of a user: a cache's exact hit."""
    turns = _t(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", text.same_words(F.col("text")).alias("key"))
    first = turns.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("b"))
    return turns.join(first, "key").select("conv_id", "turn", F.col("b.conv_id").alias("first_conv"), F.col("b.turn").alias("first_turn"))


def cache_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand as a question with its three best parts as sections."""
    p = _t(spark, sf_dir, "part").withColumn("score", recorded("top", _s("p_partkey")))
    best = p.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), "p_partkey"))).where("k <= 3")
    top = best.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p_name"))), lambda x: x["p_name"]).alias("top"))
    return top.select("p_brand", text.rich_text(F.col("p_brand"), F.col("top")).alias("text"))


def runs_in_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "#sun=").otherwise("#run="), _s("o_orderkey"), F.when(F.col("o_orderkey") % 5 == 0, "-a b").otherwise("-a_b"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.run_in_hash(address).alias("run"))


def named_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of groups like "ECONOMYs Mods" and items that name them in full, with the noun, or without it."""
    p, key = _t(spark, sf_dir, "part"), F.concat(F.lit("Item "), _s("p_partkey"))
    rows = p.select(F.col("p_partkey").alias("i"), F.when(F.col("p_partkey") % 7 == 0, F.concat(key, F.lit(" "), "p_type")).otherwise(key).alias("name"), F.concat("p_type", F.lit("s Mods")).alias("grp"))
    items = p.select(F.col("p_partkey").alias("j"), F.when(F.col("p_partkey") % 3 == 0, F.concat(key, F.lit(" "), "p_type")).otherwise(key).alias("item"))
    return tables.named_as(rows, items)


def modal_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.modal(_t(spark, sf_dir, "part").select("p_brand", "p_size"), "p_brand", "p_size")


def kept_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of brands' tables; every fifth part is a lone row, the only kind that fills the notes of most brands."""
    cols = {"name": F.col("p_name"), "size": F.when(recorded("size", _s("p_partkey")) < 90, "").otherwise(_s("p_size")), "note": F.when((F.col("p_partkey") % 5 == 0) | (F.col("p_partkey") % 97 == 0), "note").otherwise("")}
    each = F.array(*[F.struct(F.lit(c).alias("col"), v.alias("cell")) for c, v in cols.items()])
    cells = _t(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") % 5 == 0).alias("lone"), F.explode(each).alias("z")).select("p_brand", "lone", "z.*")
    return tables.kept_columns(cells, "p_brand")


def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as logs, every third stopped: what its open call may have cost."""
    lines = _log(spark, sf_dir).select("run", "idx", "depth", F.when(F.col("cost") % 4 != 0, F.col("cost")).alias("cost"), (F.col("run") % 3 == 0).alias("stopped"))
    return runlog.in_flight(lines)


def gate_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a recorded gate from 30 on beside their vector's rank in the book and the labels' good pages."""
    pages = paged(spark, sf_dir).select("book", "page", "doc_id")
    first = F.floor(F.coalesce(F.try_divide(F.col("embedding")[0].cast("double"), F.sqrt(vector.dot(F.col("embedding"), F.col("embedding")))), F.lit(-1.0)) * 1e6 + 0.5)
    similar = pages.join(_t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), first.cast("long").alias("micro")), "doc_id").select("book", "page", "micro")
    right = pages.join(_t(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    gates = pages.select("book", "page", recorded("gate", _s("doc_id")).alias("p")).where("p >= 30")
    return evaluate.gate_rows(gates, similar, right)


def _by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as scored pairs; a language is a book."""
    docs = documents(spark, sf_dir).where("lang is not null").select("doc_id", "lang")
    value = F.least(F.lit(100), recorded("value", _s("doc_id")) + F.col("quality") * 15)
    return _t(spark, sf_dir, "labels").join(docs, "doc_id").select("lang", value.alias("value"), (F.col("quality") == 1).alias("good"))


def transfer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bar picked on English documents, on the other languages."""
    return evaluate.transfer(_by_language(spark, sf_dir), "lang", "en", 0.9)


def refitted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of four languages, a fold, with the bar that the three others give."""
    fold = (F.array_position(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), F.col("lang")) - 1).cast("int")
    return evaluate.refitted(_by_language(spark, sf_dir).select(fold.alias("fold"), "value", "good").where("fold >= 0"), "fold", 4, 0.9)


def history_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of each run of a user's history (pinned first, eight others)."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("user"), (F.get_json_object("props", "$.k").cast("int") % 20).alias("id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("pinned"))
    return runlog.stepped(runlog.remembered(e, 8)).select("user", "id", "older", "newer", "successor")


def _column_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of four columns, two quantities each: recorded answers to the columns that are offered (not the first, none without
    a head) and to "none"."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table"), F.explode(F.array(F.lit(0), F.lit(1))).alias("quantity"))
    each = o.select("table", "quantity", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("pos")).where("pos <> 2 or table % 3 <> 0")
    return each.select(F.struct("table", "quantity").alias("ask_id"), F.when(F.col("pos") < 4, F.concat(F.lit("c"), _s("pos"))).otherwise("none").alias("option"), "pos", recorded("col", _s("table"), _s("quantity"), _s("pos")).alias("p"))


def column_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that each table keeps for its quantities."""
    best = decide.choice(_column_asks(spark, sf_dir))
    choices = best.select("ask_id.table", F.when(F.col("option") != "none", F.expr("try_cast(substring(option, 2) as int)")).alias("col"))
    return tables.chosen_columns(choices, "table").select("table", F.coalesce(F.array_join("keep", " "), F.lit("all")).alias("keep"))


def table_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table (a brand) that each question (a size) asks for, by its recorded answer; the first on ties."""
    a = _t(spark, sf_dir, "part").groupBy("p_size", "p_brand").agg(F.min("p_partkey").alias("pos"))
    asks = a.select(F.col("p_size").alias("ask_id"), F.col("p_brand").alias("option"), "pos", recorded("table", _s("p_size"), F.col("p_brand")).alias("p"))
    return decide.choice(asks).select(F.col("ask_id").alias("p_size"), F.col("option").alias("p_brand"), "p")


def label_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of entries (a type) for each column (a brand), null where "none" is likelier."""
    a = _t(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("pos")).select(F.col("p_brand").alias("ask_id"), F.col("p_type").alias("option"), "pos")
    none = a.select("ask_id").distinct().select("ask_id", F.lit("none").alias("option"), F.lit(1 << 40).alias("pos"))
    asks = a.unionByName(none).withColumn("p", recorded("label", F.col("ask_id"), F.col("option")))
    return decide.choice(asks).select(F.col("ask_id").alias("p_brand"), F.nullif(F.col("option"), F.lit("none")).alias("label"), "p")


def own_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece of a part's cells that states what is missing; rows without one are left open."""
    cell = F.concat("p_name", F.lit(" ("), "p_type", F.lit("), "), "p_brand")
    pieces = _t(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.concat(tables.pieces(cell), F.array(F.lit("none")))).alias("pos", "piece"))
    asks = pieces.select(F.col("p_partkey").alias("ask_id"), F.col("piece").alias("option"), "pos", recorded("own", _s("p_partkey"), F.col("piece")).alias("p"))
    return decide.choice(asks).where("option <> 'none'").select(F.col("ask_id").alias("p_partkey"), F.col("option").alias("piece"), "p")


def answers_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, figures and claims as one table of answers: each kind by its own reader."""
    counts = answer_queries.count_cells(spark, sf_dir).select(F.lit("count").alias("kind"), F.col("window").alias("asked"), _s("n").alias("text"))
    numbers = answer_queries.several_figures(spark, sf_dir).select(F.lit("number").alias("kind"), _s("l_orderkey").alias("asked"), "text")
    truths = answer_queries.claim_verdict(spark, sf_dir).select(F.lit("truth").alias("kind"), F.concat_ws("/", "book", _s("page")).alias("asked"), "text")
    return counts.unionByName(numbers).unionByName(truths)


_ALL = (bare_names, cached_question, cache_texts, runs_in_addresses, named_rows, modal_size, kept_columns, in_flight, gate_study, transfer_check, refitted_bars, history_steps, column_choices, table_choice, label_choices, own_cells, answers_by_kind)
QUERIES = {f.__name__: f for f in _ALL}


def _r(salt: str, *cols: str) -> str:
    return rec(f"'{salt}'", *[f"CAST({c} AS VARCHAR)" for c in cols])


_LANG = f"lb AS (SELECT lang, least(100, {_r('value', 'doc_id')} + quality * 15) AS value, quality = 1 AS good FROM labels JOIN documents USING (doc_id) WHERE lang IS NOT NULL), ct AS (SELECT lang, value, count(*) FILTER (good) AS g, count(*) AS n FROM lb GROUP BY ALL)"
_PICK = "row_number() OVER (PARTITION BY held ORDER BY tp DESC, value DESC) AS k FROM sw WHERE tp >= taken * 0.9::DOUBLE"
_OWN = "o AS (SELECT p_partkey, p_name || ' (' || p_type || '), ' || p_brand AS c, p_name AS a, p_type AS b, p_brand FROM part), l AS (SELECT p_partkey, [c, a, b, ', ' || p_brand, a || ' (' || b || ')', p_brand, 'none'] AS l FROM o), e AS (SELECT p_partkey, unnest(range(1, 8)) AS k, unnest(l) AS piece FROM l), f AS (SELECT p_partkey, piece, min(k) AS pos FROM e GROUP BY ALL)"


ORACLE = {
    "bare_names": "WITH n AS (SELECT p_partkey, p_name || [' ......12', ' (x2)', ':', ' (a) (b).'][p_partkey % 4 + 1] AS n FROM part) SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(n, '\\s*\\.{3,}.*$', ''), '\\s*\\([^)]*\\)\\s*$', ''), '[:.]$', '')) AS name FROM n",
    "cached_question": "WITH t AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key FROM conversations WHERE role = 'user') SELECT conv_id, turn, first_value(conv_id) OVER w AS first_conv, first_value(turn) OVER w AS first_turn FROM t WINDOW w AS (PARTITION BY key ORDER BY conv_id, turn)",
    "cache_texts": f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY {_r('top', 'p_partkey')} DESC, p_partkey) AS k FROM part) SELECT p_brand, p_brand || chr(10) || 'Sections: ' || string_agg(p_name, '; ' ORDER BY k) AS text FROM p WHERE k <= 3 GROUP BY p_brand",
    "runs_in_addresses": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS VARCHAR) || '-a_b' END AS run FROM orders",
    "named_rows": f"""WITH p AS (SELECT *, 'Item ' || CAST(p_partkey AS VARCHAR) AS key FROM part), r AS (SELECT p_partkey AS i, {norm("CASE WHEN p_partkey % 7 = 0 THEN key || ' ' || p_type ELSE key END")} AS n, trim(regexp_replace({norm("p_type || 's Mods'")}, '\\s*\\bmods?\\b\\s*', ' ', 'g')) AS u FROM p),
s AS (SELECT *, {sing('u')} AS v FROM r), t AS (SELECT p_partkey AS j, {norm("CASE WHEN p_partkey % 3 = 0 THEN key || ' ' || p_type ELSE key END")} AS w FROM p)
SELECT i, j FROM s, t WHERE w = n OR (u <> '' AND (w = n || ' ' || u OR n = w || ' ' || u OR w = n || ' ' || v OR n = w || ' ' || v))""",
    "modal_size": "WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS k FROM c) SELECT p_brand, p_size, n FROM k WHERE k = 1",
    "kept_columns": f"WITH c AS (SELECT p_brand, p_partkey % 5 = 0 AS lone, unnest(['name', 'size', 'note']) AS col, unnest([p_name, CASE WHEN {_r('size', 'p_partkey')} < 90 THEN '' ELSE CAST(p_size AS VARCHAR) END, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 97 = 0 THEN 'note' ELSE '' END]) AS cell FROM part) SELECT DISTINCT p_brand, col FROM c WHERE cell <> '' AND NOT lone",
    "in_flight": f"WITH {_LOG}, l AS (SELECT run, cost, coalesce(lead(depth) OVER (PARTITION BY run ORDER BY idx) <= depth, true) AS leaf FROM lg WHERE run % 3 = 0) SELECT run, CAST(floor(CAST(sum(cost) FILTER (leaf AND cost % 4 <> 0) AS DOUBLE) / count(*) FILTER (leaf AND cost % 4 <> 0) + 0.5) AS BIGINT) AS cost FROM l GROUP BY run",
    "gate_study": f"""WITH {PAGES}, s AS (SELECT book, page, CAST(floor(coalesce(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), -1) * 1000000 + 0.5) AS BIGINT) AS micro FROM pg JOIN embeddings ON vec_id = doc_id),
r AS (SELECT book, page, row_number() OVER (PARTITION BY book ORDER BY micro DESC, page) AS rank, micro - max(micro) OVER (PARTITION BY book) AS rel FROM s), g AS (SELECT book, page, doc_id, {_r('gate', 'doc_id')} AS p FROM pg)
SELECT book, page, p, rank, rel, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS answer FROM g JOIN r USING (book, page) WHERE p >= 30""",
    "transfer_check": f"""WITH {_LANG}, sw AS (SELECT lang AS held, value, sum(g) OVER (ORDER BY value DESC) AS tp, sum(n) OVER (ORDER BY value DESC) AS taken FROM ct WHERE lang = 'en'), b AS (SELECT value AS bar, {_PICK})
SELECT lang, bar, CAST(coalesce(sum(g) FILTER (value >= bar), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (value >= bar), 0) AS BIGINT) AS taken, CAST(sum(g) AS BIGINT) AS good FROM ct, b WHERE k = 1 AND lang <> 'en' GROUP BY lang, bar""",
    "refitted_bars": f"""WITH {_LANG}, f AS (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS fold, unnest(['de', 'en', 'es', 'fr']) AS lang), o AS (SELECT f.fold AS held, value, sum(g) AS g, sum(n) AS n FROM ct JOIN f ON f.lang <> ct.lang WHERE ct.lang IN (SELECT lang FROM f) GROUP BY ALL),
sw AS (SELECT held, value, sum(g) OVER w AS tp, sum(n) OVER w AS taken FROM o WINDOW w AS (PARTITION BY held ORDER BY value DESC)), b AS (SELECT held, value AS bar, {_PICK})
SELECT fold, bar, CAST(coalesce(sum(g) FILTER (value >= bar), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (value >= bar), 0) AS BIGINT) AS taken, CAST(sum(g) AS BIGINT) AS good FROM ct JOIN f USING (lang) JOIN b ON held = fold WHERE k = 1 GROUP BY fold, bar""",
    "history_steps": """WITH e AS (SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS id, ts, event_id, event_type = 'purchase' AS pinned FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY "user", id ORDER BY ts DESC, event_id DESC) AS k FROM e),
c AS (SELECT *, sum(CASE WHEN pinned THEN 0 ELSE 1 END) OVER (PARTITION BY "user" ORDER BY ts DESC, event_id DESC) AS n FROM n WHERE k = 1), h AS (SELECT * FROM c WHERE pinned OR n <= 8)
SELECT "user", id, lead(id) OVER t AS older, lag(id) OVER t AS newer, coalesce(lead(id) OVER l, lag(id) OVER l) AS successor FROM h WINDOW t AS (PARTITION BY "user" ORDER BY ts DESC, pinned DESC, event_id DESC), l AS (PARTITION BY "user" ORDER BY pinned DESC, ts DESC, event_id DESC)""",
    "column_choices": f"""WITH o AS (SELECT o_orderkey AS "table", unnest([0, 1]) AS quantity FROM orders), a AS (SELECT *, unnest([1, 2, 3, 4]) AS pos FROM o), p AS (SELECT *, {_r('col', '"table"', 'quantity', 'pos')} AS p FROM a WHERE pos <> 2 OR "table" % 3 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY "table", quantity ORDER BY p DESC, pos) AS k FROM p), d AS (SELECT DISTINCT "table", pos FROM k WHERE k = 1)
SELECT "table", CASE WHEN count(*) FILTER (pos < 4) = 0 THEN 'all' ELSE '0 ' || string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) FILTER (pos < 4) END AS keep FROM d GROUP BY "table\"""",
    "table_choice": f"WITH a AS (SELECT p_size, p_brand, min(p_partkey) AS pos FROM part GROUP BY ALL), p AS (SELECT *, {_r('table', 'p_size', 'p_brand')} AS p FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p DESC, pos) AS k FROM p) SELECT p_size, p_brand, p FROM k WHERE k = 1",
    "label_choices": f"WITH a AS (SELECT p_brand, p_type AS o, min(p_partkey) AS pos FROM part GROUP BY ALL UNION ALL SELECT DISTINCT p_brand, 'none', 1099511627776 FROM part), p AS (SELECT *, {_r('label', 'p_brand', 'o')} AS p FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p DESC, pos) AS k FROM p) SELECT p_brand, nullif(o, 'none') AS label, p FROM k WHERE k = 1",
    "own_cells": f"WITH {_OWN}, p AS (SELECT *, {_r('own', 'p_partkey', 'piece')} AS p FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY p DESC, pos) AS k FROM p) SELECT p_partkey, piece, p FROM k WHERE k = 1 AND piece <> 'none'",
    "answers_by_kind": f"""SELECT 'count' AS kind, "window" AS asked, CAST(n AS VARCHAR) AS text FROM ({answer_queries.ORACLE['count_cells']}) UNION ALL SELECT 'number', CAST(l_orderkey AS VARCHAR), text FROM ({answer_queries.ORACLE['several_figures']}) UNION ALL SELECT 'truth', book || '/' || CAST(page AS VARCHAR), text FROM ({answer_queries.ORACLE['claim_verdict']})""",
}
