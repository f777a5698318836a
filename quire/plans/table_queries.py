"""Queries of tables, evaluation, run logs, history and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import quantised
from quire.operators import evaluate, export, runlog, tables, vector
from quire.plans._q import PAGES, documents, norm, paged, q6
from quire.plans.answer_queries import rec, recorded
from quire.sources import shelf


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shelf.table(spark, sf_dir, name)


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as paragraphs: returned ones text, accepted ones lone rows, the rest rows headed by their status."""
    cells = F.when(F.col("l_returnflag") == "A", F.array(F.lit(""), F.concat(F.lit("group "), F.col("l_partkey").cast("string")))).otherwise(F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string")))
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", pos.alias("pos"), F.when(F.col("l_returnflag") == "R", "text").otherwise("row").alias("kind"), F.lit("prose").alias("text"), F.col("l_linestatus").alias("heads"), cells.alias("cells"))


def tables_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.tables_from(_order_rows(spark, sf_dir), "l_orderkey", "pos")
    return out.select("l_orderkey", "pos", "table_id", "heads", F.coalesce("grp", F.lit("")).alias("grp"), F.element_at("cells", 1).alias("cell"))


def row_text_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_name")), F.col("p_brand"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit('12" '), F.col("p_type"))), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_size").cast("string")))
    heads = tables.heads_named(F.array(F.lit("name"), F.lit(""), F.lit("name"), F.lit("name 2")))
    return _t(spark, sf_dir, "part").select("p_partkey", tables.row_text(heads, cells).alias("text"))


def same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.upper(F.replace("s_name", F.lit("#"), F.lit(" no. "))).alias("name"))
    theirs = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("j"), F.replace("s_name", F.lit("#"), F.lit("-no-")).alias("name")).where("j % 3 <> 0")
    return tables.same_names(ours, theirs)


_TAG = r"<(h1|p|li)>([^<]*)"


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs and list items of pages, as marked up."""
    html = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.regexp_extract_all("html", F.lit(_TAG), F.lit(1)).alias("tags"), F.regexp_extract_all("html", F.lit(_TAG), F.lit(2)).alias("texts"))
    rows = html.select("doc", F.posexplode(F.arrays_zip("tags", "texts")).alias("pos", "z"))
    return rows.select("doc", "pos", (F.col("z.tags") == "h1").alias("heading"), F.trim("z.texts").alias("text"))


def entries_by_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs under each page's heading, short paragraphs being headings too."""
    paras = _paragraphs(spark, sf_dir).withColumn("heading", F.col("heading") | ((F.length("text") > 10) & (F.length("text") < 40)))
    names = paras.where("heading").groupBy("doc", F.col("text").alias("name")).agg(F.max("pos").alias("i"))
    return tables.entries(paras, names).select("doc", "i", "pos", F.length("text").alias("chars"))


def cell_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat_ws("", "p_name", F.lit(" ("), "p_type", F.lit("), "), "p_brand", F.lit("; size "), F.col("p_size").cast("string"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.posexplode(tables.pieces(cell)).alias("pos", "piece"))


def _part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    cols = {"name": F.col("p_name"), "type": F.when(recorded("type", key) < 60, "").otherwise(F.col("p_type")), "size": F.when(recorded("size", key) < 40, "").otherwise(F.col("p_size").cast("string"))}
    each = F.array(*[F.struct(F.lit(c).alias("col"), v.alias("cell")) for c, v in cols.items()])
    return _t(spark, sf_dir, "part").select("p_brand", F.explode(each).alias("z")).select("p_brand", "z.*")


def mostly_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.mostly_filled(_part_cells(spark, sf_dir), "p_brand")


def annotate_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments as items: the nearest order page (by key) of that segment with a value."""
    orders = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.groupBy(F.col("c_mktsegment").alias("key"), F.floor(F.col("o_orderkey") / 50).alias("row_page")).agg(F.min("o_orderkey").alias("row_pos"))
    rows = rows.select("key", "row_page", (F.col("row_pos") % 3).alias("table_pos"), "row_pos", F.col("row_pos").cast("string").alias("value"))
    items = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.when(F.col("c_custkey") % 20 == 3, F.lit("unlisted")).otherwise(F.col("c_mktsegment")).alias("key"), F.floor(F.col("c_custkey") / 25).alias("page"))
    return tables.annotate(items, rows).select("item", "page", "value")


def compose_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of parts from up to four recorded sources each, the best one used."""
    key = F.col("p_partkey").cast("string")
    each = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(c).alias("col"), F.lit(i).alias("pos"), F.when(recorded(s, c, key) < 50, F.lit("N/A")).otherwise(v).alias("text")) for i, (s, c, v) in enumerate([("entry", "type", F.col("p_type")), ("table", "type", F.lower("p_type")), ("own", "size", F.col("p_size").cast("string")), ("derived", "size", F.lit("about")), ("derived", "type", F.lit("kind"))])])
    cells = _t(spark, sf_dir, "part").select("p_partkey", F.explode(each).alias("z")).select("p_partkey", "z.*")
    return tables.composed(cells, "p_partkey", "col")


def _across_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are books, columns languages; a cell is the number of pages, or why there is none."""
    found = documents(spark, sf_dir).groupBy(F.col("source").alias("row"), F.col("lang").alias("col")).agg(F.count("*").alias("n"), F.max(F.length("text")).alias("chars"))
    few = F.col("n") < 5
    return found.select("row", "col", F.when(few, "N/A").otherwise("count").alias("kind"), F.when(F.col("chars") < 2000, "nothing readable").when(few, "below the floor").alias("why"), F.col("n").cast("string").alias("text"))


def across_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.across(_across_cells(spark, sf_dir), ["de", "en", "es", "fr"])


def across_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _across_cells(spark, sf_dir).where("kind = 'N/A'").groupBy("why").agg(F.count("*").alias("cells"))


def _scores(spark: SparkSession, sf_dir: str, salt: str) -> DataFrame:
    """Word counts of labelled documents against recorded, partly missing and repeated, readings."""
    rows = _t(spark, sf_dir, "labels").join(documents(spark, sf_dir), "doc_id").select("doc_id", F.size(F.split("text", " ")).alias("truth"))
    key = F.col("doc_id").cast("string")
    got = rows.select(F.col("doc_id").alias("case"), F.explode(F.array(F.lit(1), F.lit(2))).alias("at"), "truth", recorded(salt, key).alias("r")).where("r > 10 and (at = 1 or r > 40)")
    got = got.select("case", "at", (F.col("truth") + (F.col("r") - 60) * F.col("at")).alias("value"))
    return evaluate.case_scores(rows.select(F.col("doc_id").alias("case"), "truth"), got)


def bench_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "now").select("case", quantised(F.col("score")).alias("score"))


def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.regressions(_scores(spark, sf_dir, "now"), _scores(spark, sf_dir, "before"))
    return out.groupBy("mark").agg(F.count("*").alias("cases"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    value = F.least(F.lit(100), recorded("value", key) + F.col("quality") * 15)
    return _t(spark, sf_dir, "labels").select("doc_id", value.alias("value"), (F.col("quality") == 1).alias("good"), recorded("other", key).alias("other"))


def precision_recall_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sweep(_labelled(spark, sf_dir)).select("value", "tp", "taken", *[quantised(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.average_precision(evaluate.sweep(_labelled(spark, sf_dir))).select(quantised(F.col("ap")).alias("ap"))


def rule_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = spark.range(0, 36).select(((F.col("id") % 6) * 20).cast("int").alias("a_bar"), (F.floor(F.col("id") / 6) * 20).cast("int").alias("b_bar"))
    pairs = _labelled(spark, sf_dir).select(F.col("value").alias("a"), F.col("other").alias("b"), "good")
    return evaluate.rule_grid(pairs, bars)


def band_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bands(_labelled(spark, sf_dir), 50.0, 10.0)


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id is divisible by 100 ask for one of their label: where the first right one ranks among all the others."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("label").alias("book"), F.col("vec_id").alias("page"), F.col("embedding").cast("array<double>").alias("v"))
    first = vector.first_of_book(e, e.where("page % 100 = 0").withColumnRenamed("page", "qid"))
    return evaluate.recall_at(first).select("k", quantised(F.col("recall")).alias("recall"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run a user and day, a tool an event type; dollars are whole cents."""
    e = _t(spark, sf_dir, "events")
    day = F.to_date("ts")
    return e.select(F.concat_ws("/", F.col("user_id").cast("string"), day.cast("string")).alias("run"), "event_id", "ts", "event_type", F.col("event_type").alias("tool"), day.alias("day"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("dollars"), (F.get_json_object("props", "$.k").cast("int") % 4 != 0).alias("sent"))


def ledger_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.ledger(_events(spark, sf_dir)).select(F.col("day").cast("string").alias("day"), "tool", "dollars")


def spend_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = runlog.ledger(_events(spark, sf_dir))
    return runlog.spend_window(daily, F.to_date(F.lit("2024-01-09")), 7, ["click", "error", "purchase", "signup", "view"])


def run_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runlog.runs(_events(spark, sf_dir))
    status = F.when(F.col("last") == "error", "failed").when(F.col("errors") > 0, "recovered").otherwise("ended")
    return out.select("run", "lines", "last", "errors", status.alias("status"), (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("began").cast("timestamp"))).alias("micros"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as run logs: depth by role, cost by length."""
    depth = F.when(F.col("role") == "user", 0).when(F.col("turn") % 3 == 1, 1).otherwise(2)
    return _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("idx"), depth.alias("depth"), F.length("text").cast("long").alias("cost"), "text")


def log_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.parents(_log(spark, sf_dir), 2).select("run", "idx", "depth", "parent")


def spend_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.rolled_up(_log(spark, sf_dir), 2).select("run", "idx", "depth", "cost", "total")


def log_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last, largest and counted facts of each log, from its lines' first words."""
    first = F.regexp_extract(F.lower("text"), "^([a-z]+)", 1)
    rows = _log(spark, sf_dir).withColumn("word", first)
    return rows.groupBy("run").agg(F.min_by("word", "idx").alias("first"), F.max_by("word", "idx").alias("last"), F.max("cost").alias("largest"), F.count_if(F.col("word") != "").alias("worded"))


def lru_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page cache of 10000 characters for each source and language."""
    files = documents(spark, sf_dir).select(F.concat_ws("/", "source", "lang").alias("cache"), F.col("doc_id").alias("id"), recorded("at", F.col("doc_id").cast("string")).alias("at"), F.length("text").cast("long").alias("bytes"))
    return runlog.overflow(files, 10000)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").where("role = 'user'").select(F.substring_index("text", " ", 2).alias("q"), F.col("conv_id").alias("at"), F.col("turn").alias("id"))


def history_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.recent(_questions(spark, sf_dir), "la", 5)


def history_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations")
    return runlog.holding_all(rows, "text", ["la", "de", "que"]).select("conv_id", "turn", "role")


def palette_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("label"), F.col("p_type").alias("more"))
    return runlog.palette(rows, "label", "more", ["small"], 40).select("ord", "label", "rank")


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    odd = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.col("p_name"), F.lit(', "best"|\tone'))).otherwise(F.col("p_name"))
    return _t(spark, sf_dir, "part"), [odd, F.col("p_brand"), F.col("p_type"), F.col("p_size")]


def export_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, cells = _parts(spark, sf_dir)
    return part.select("p_partkey", export.tsv(cells).alias("line"))


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, cells = _parts(spark, sf_dir)
    return part.select("p_partkey", export.csv(cells).alias("line"))


def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, cells = _parts(spark, sf_dir)
    return part.select("p_partkey", export.markdown(cells).alias("line"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page stands, its elided first line and the file stem of it."""
    pages = paged(spark, sf_dir)
    first = F.substring_index("text", "\n", 1)
    path = F.when(F.col("page") % 2 == 0, F.concat(F.lit("part "), F.ceil(F.col("page") / 5).cast("string")))
    return pages.select("doc_id", export.citation(F.col("book"), F.col("page"), path).alias("citation"), export.elide(first, 24).alias("line"), export.stem(F.regexp_replace(first, "[^A-Za-z0-9 ]", "")).alias("stem"))


_ALL = (tables_from_rows, row_text_json, same_names, entries_by_heading, cell_pieces, mostly_filled, annotate_nearest, compose_table, across_pivot, across_reasons, bench_scores, regressions, precision_recall_sweep, average_precision, rule_grid, band_histogram, recall_at_k, ledger_daily, spend_window, run_reducer, log_tree, spend_rollup, log_facts, lru_overflow, history_recent, history_filter, palette_match, export_tsv, export_csv, export_markdown, citations)
QUERIES = {f.__name__: f for f in _ALL}

_ODD = "CASE WHEN p_partkey % 7 = 0 THEN p_name || ', \"best\"|' || chr(9) || 'one' ELSE p_name END"


def _sc(salt: str) -> str:
    return f"""(WITH r AS (SELECT doc_id, len(string_split(text, ' ')) AS truth, {rec(f"'{salt}'", 'CAST(doc_id AS VARCHAR)')} AS r FROM labels JOIN documents USING (doc_id)),
v AS (SELECT doc_id, truth, CASE WHEN r > 40 THEN truth + (r - 60) * 2 WHEN r > 10 THEN truth + (r - 60) END AS value FROM r)
SELECT doc_id AS "case", CASE WHEN value IS NULL OR truth = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - abs(value - truth)::DOUBLE / truth::DOUBLE) END AS score FROM v)"""


_LAB = f"lb AS (SELECT doc_id, least(100, {rec(chr(39) + 'value' + chr(39), 'CAST(doc_id AS VARCHAR)')} + quality * 15) AS value, quality = 1 AS good, {rec(chr(39) + 'other' + chr(39), 'CAST(doc_id AS VARCHAR)')} AS other FROM labels)"
_SWEEP = f"""{_LAB}, gr AS (SELECT value, count(*) FILTER (good) AS g, count(*) AS n FROM lb GROUP BY value),
dn AS (SELECT value, g, CAST(sum(g) OVER (ORDER BY value DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY value DESC) AS BIGINT) AS taken, CAST(sum(g) OVER () AS BIGINT) AS ag FROM gr),
pr AS (SELECT *, tp::DOUBLE / taken AS precision, CASE WHEN ag > 0 THEN tp::DOUBLE / ag END AS recall FROM dn)"""
_EV = "ev AS (SELECT CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run, event_id, ts, event_type, event_type AS tool, CAST(ts AS DATE) AS day, CAST(floor(value * 100 + 0.5) AS BIGINT) AS dollars, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 <> 0 AS sent FROM events)"
_LEDGER = f"{_EV}, ch AS (SELECT run, tool, day, max(dollars) AS dollars FROM ev WHERE sent GROUP BY ALL), dl AS (SELECT day, tool, CAST(sum(dollars) AS BIGINT) AS dollars FROM ch GROUP BY ALL)"
_LOG = "lg AS (SELECT conv_id AS run, turn AS idx, CAST(CASE WHEN role = 'user' THEN 0 WHEN turn % 3 = 1 THEN 1 ELSE 2 END AS INTEGER) AS depth, CAST(length(text) AS BIGINT) AS cost, text FROM conversations)"
_AC = "ac AS (SELECT source AS row, lang AS col, count(*) AS n, max(length(text)) AS chars FROM documents GROUP BY ALL), aw AS (SELECT row, col, n, CASE WHEN n < 5 THEN 'N/A' ELSE 'count' END AS kind, CASE WHEN chars < 2000 THEN 'nothing readable' WHEN n < 5 THEN 'below the floor' END AS why FROM ac)"
ORACLE = {
    "tables_from_rows": """WITH p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_returnflag AS f, l_linestatus AS heads, l_partkey FROM lineitem),
s AS (SELECT *, sum(CASE WHEN f = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY pos) AS stretch FROM p),
g AS (SELECT *, last_value(CASE WHEN f = 'A' THEN 'group ' || CAST(l_partkey AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY l_orderkey, stretch ORDER BY pos) AS grp FROM s),
d AS (SELECT *, coalesce(lag(heads) OVER (PARTITION BY l_orderkey, stretch ORDER BY pos) <> heads, true) AS begins FROM g WHERE f NOT IN ('A', 'R'))
SELECT l_orderkey, CAST(pos AS INTEGER) AS pos, CAST(sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY pos) AS BIGINT) AS table_id, heads, coalesce(grp, '') AS grp, CAST(l_partkey AS VARCHAR) AS cell FROM d""",
    "row_text_json": """WITH c AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS a, p_brand AS b, CASE WHEN p_size % 3 = 0 THEN '' ELSE '12\\" ' || p_type END AS c, CASE WHEN p_size % 2 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS d FROM part)
SELECT p_partkey, CASE WHEN a = '' AND c = '' AND d = '' THEN b ELSE '{' || concat_ws(',', CASE WHEN a <> '' THEN '"name":"' || a || '"' END, '"column 2":"' || b || '"', CASE WHEN c <> '' THEN '"name 2":"' || c || '"' END, CASE WHEN d <> '' THEN '"name 2 2":"' || d || '"' END) || '}' END AS text FROM c""",
    "same_names": f"WITH o AS (SELECT s_suppkey AS i, upper(replace(s_name, '#', ' no. ')) AS name FROM supplier), t AS (SELECT s_suppkey * 2 AS j, {norm(chr(39).join(['replace(s_name, ', '#', ', ', '-no-', ')']))} AS key FROM supplier WHERE s_suppkey * 2 % 3 <> 0), m AS (SELECT key, max(j) AS j FROM t GROUP BY key) SELECT i, name, j FROM o LEFT JOIN m ON key = {norm('name')}",
    "entries_by_heading": f"""WITH h AS (SELECT page_id AS doc, regexp_extract_all(html, '{_TAG}', 1) AS a, regexp_extract_all(html, '{_TAG}', 2) AS b FROM pages), p0 AS (SELECT doc, CAST(unnest(range(0, len(a))) AS INTEGER) AS pos, unnest(a) AS tag, trim(unnest(b)) AS text FROM h),
p AS (SELECT *, tag = 'h1' OR (length(text) > 10 AND length(text) < 40) AS heading FROM p0), n AS (SELECT doc, text AS name, max(pos) AS i FROM p WHERE heading GROUP BY ALL),
w AS (SELECT doc, {norm('name')} AS key, max(i) AS i FROM n GROUP BY ALL), u AS (SELECT *, max(CASE WHEN heading THEN pos END) OVER (PARTITION BY doc ORDER BY pos) AS hp FROM p),
f AS (SELECT p.doc, w.i, min(p.pos) AS hp FROM p JOIN w ON w.doc = p.doc AND w.key = {norm('p.text')} WHERE heading GROUP BY ALL)
SELECT u.doc, f.i, u.pos, CAST(length(u.text) AS INTEGER) AS chars FROM u JOIN f ON f.doc = u.doc AND f.hp = u.hp WHERE NOT u.heading""",
    "cell_pieces": """WITH c AS (SELECT p_partkey, p_name || ' (' || p_type || '), ' || p_brand || '; size ' || CAST(p_size AS VARCHAR) AS c, p_name AS a, p_type AS b, p_brand, p_size FROM part),
l AS (SELECT p_partkey, [c, a, b, ', ' || p_brand || '; size ' || CAST(p_size AS VARCHAR), a || ' (' || b || ')', p_brand, 'size ' || CAST(p_size AS VARCHAR)] AS l FROM c), e AS (SELECT p_partkey, unnest(range(1, 8)) AS k, unnest(l) AS piece FROM l), f AS (SELECT p_partkey, piece, min(k) AS k FROM e GROUP BY ALL)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1 AS INTEGER) AS pos, piece FROM f""",
    "mostly_filled": f"""WITH k AS (SELECT p_brand, unnest(['name', 'type', 'size']) AS col, unnest([p_name, CASE WHEN {rec("'type'", 'CAST(p_partkey AS VARCHAR)')} < 60 THEN '' ELSE p_type END, CASE WHEN {rec("'size'", 'CAST(p_partkey AS VARCHAR)')} < 40 THEN '' ELSE CAST(p_size AS VARCHAR) END]) AS cell FROM part),
g AS (SELECT p_brand, col, count(*) AS rows, count(*) FILTER (cell <> '') AS filled FROM k GROUP BY ALL) SELECT p_brand, col, rows, filled FROM g WHERE filled >= greatest(least(rows, 2)::DOUBLE, rows * 0.5::DOUBLE)""",
    "annotate_nearest": """WITH r AS (SELECT c_mktsegment AS key, o_orderkey // 50 AS row_page, min(o_orderkey) AS row_pos FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
i AS (SELECT c_custkey AS item, CASE WHEN c_custkey % 20 = 3 THEN 'unlisted' ELSE c_mktsegment END AS key, c_custkey // 25 AS page FROM customer),
m AS (SELECT item, page, CAST(row_pos AS VARCHAR) AS value, row_number() OVER (PARTITION BY item, page ORDER BY abs(row_page - page), row_pos % 3, row_pos) AS k FROM i LEFT JOIN r USING (key)) SELECT item, page, coalesce(value, 'N/A') AS value FROM m WHERE k = 1""",
    "compose_table": f"""WITH k AS (SELECT p_partkey, unnest(['entry', 'table', 'own', 'derived', 'derived']) AS source, unnest(['type', 'type', 'size', 'size', 'type']) AS col, unnest([1, 2, 3, 4, 4]) AS rank,
 unnest([CASE WHEN {rec("'entry'", "'type'", 'CAST(p_partkey AS VARCHAR)')} >= 50 THEN p_type END, CASE WHEN {rec("'table'", "'type'", 'CAST(p_partkey AS VARCHAR)')} >= 50 THEN lower(p_type) END, CASE WHEN {rec("'own'", "'size'", 'CAST(p_partkey AS VARCHAR)')} >= 50 THEN CAST(p_size AS VARCHAR) END, CASE WHEN {rec("'derived'", "'size'", 'CAST(p_partkey AS VARCHAR)')} >= 50 THEN 'about' END, CASE WHEN {rec("'derived'", "'type'", 'CAST(p_partkey AS VARCHAR)')} >= 50 THEN 'kind' END]) AS text FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, col ORDER BY text IS NULL, rank) AS k FROM k) SELECT p_partkey, col, coalesce(text, '') AS text, CASE WHEN text IS NULL THEN 'none' ELSE source END AS source FROM b WHERE k = 1""",
    "across_pivot": f"WITH {_AC}, s AS (SELECT row, col, CASE WHEN kind = 'N/A' THEN 'N/A: ' || why ELSE CAST(n AS VARCHAR) END AS s FROM aw) SELECT row, max(s) FILTER (col = 'de') AS de, max(s) FILTER (col = 'en') AS en, max(s) FILTER (col = 'es') AS es, max(s) FILTER (col = 'fr') AS fr FROM s GROUP BY row",
    "across_reasons": f"WITH {_AC} SELECT why, count(*) AS cells FROM aw WHERE kind = 'N/A' GROUP BY why",
    "bench_scores": f'SELECT "case", {q6("score")} AS score FROM {_sc("now")}',
    "regressions": f"""SELECT CASE WHEN n.score - b.score < -0.05 THEN 'down' WHEN n.score - b.score > 0.05 THEN 'up' ELSE 'same' END AS mark, count(*) AS cases FROM {_sc("now")} n JOIN {_sc("before")} b USING ("case") GROUP BY 1""",
    "precision_recall_sweep": f"WITH {_SWEEP} SELECT value, tp, taken, {q6('precision')} AS precision, {q6('recall')} AS recall, {q6('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END')} AS f1 FROM pr",
    "average_precision": f"WITH {_SWEEP} SELECT {q6('sum(precision * g) / sum(g)')} AS ap FROM pr",
    "rule_grid": f"WITH {_LAB}, a AS (SELECT CAST(unnest(range(0, 120, 20)) AS INTEGER) AS a_bar), b AS (SELECT CAST(unnest(range(0, 120, 20)) AS INTEGER) AS b_bar) SELECT a_bar, b_bar, count(*) FILTER (good AND (value >= a_bar OR other >= b_bar)) AS or_good, count(*) FILTER (value >= a_bar OR other >= b_bar) AS or_taken, count(*) FILTER (good AND value >= a_bar AND other >= b_bar) AS and_good, count(*) FILTER (value >= a_bar AND other >= b_bar) AS and_taken FROM lb, a, b GROUP BY ALL",
    "band_histogram": f"WITH {_LAB} SELECT CAST(floor((value - 50.0::DOUBLE) / 10) AS INTEGER) AS band, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM lb GROUP BY ALL",
    "recall_at_k": f"""WITH n AS (SELECT a.vec_id, a.label = b.label AS ok, row_number() OVER (PARTITION BY a.vec_id ORDER BY floor(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 1000000 + 0.5) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
f AS (SELECT vec_id, min(rank) FILTER (ok) AS rank FROM n GROUP BY vec_id), k AS (SELECT CAST(unnest([1, 3, 5, 12, 30]) AS INTEGER) AS k) SELECT k, {q6('avg(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS recall FROM f, k GROUP BY k""",
    "ledger_daily": f"WITH {_LEDGER}, d AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS k FROM (SELECT DISTINCT day FROM dl)) SELECT CAST(dl.day AS VARCHAR) AS day, tool, dollars FROM dl JOIN d ON d.day = dl.day WHERE k <= 90",
    "spend_window": f"WITH {_LEDGER} SELECT CAST(coalesce(sum(dollars), 0) AS BIGINT) AS dollars, " + ", ".join(f"CAST(coalesce(sum(dollars) FILTER (tool = '{t}'), 0) AS BIGINT) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM dl WHERE day <= DATE '2024-01-09' AND day > DATE '2024-01-09' - 7",
    "run_reducer": f"WITH {_EV}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts DESC, event_id DESC) AS k FROM ev), r AS (SELECT run, count(*) AS lines, max(event_type) FILTER (k = 1) AS last, count(*) FILTER (event_type = 'error') AS errors, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM k GROUP BY run) SELECT run, lines, last, errors, CASE WHEN last = 'error' THEN 'failed' WHEN errors > 0 THEN 'recovered' ELSE 'ended' END AS status, micros FROM r",
    "log_tree": f"WITH {_LOG} SELECT a.run, a.idx, a.depth, (SELECT max(b.idx) FROM lg b WHERE b.run = a.run AND b.idx < a.idx AND b.depth < a.depth) AS parent FROM lg a",
    "spend_rollup": f"WITH {_LOG}, n AS (SELECT a.run, a.idx, (SELECT min(b.idx) FROM lg b WHERE b.run = a.run AND b.idx > a.idx AND b.depth <= a.depth) AS nx FROM lg a) SELECT a.run, a.idx, a.depth, a.cost, (SELECT CAST(sum(c.cost) AS BIGINT) FROM lg c WHERE c.run = a.run AND c.idx >= a.idx AND (nx IS NULL OR c.idx < nx)) AS total FROM lg a JOIN n ON n.run = a.run AND n.idx = a.idx",
    "log_facts": f"WITH {_LOG}, w AS (SELECT *, regexp_extract(lower(text), '^([a-z]+)', 1) AS word FROM lg) SELECT run, arg_min(word, idx) AS first, arg_max(word, idx) AS last, max(cost) AS largest, count(*) FILTER (word <> '') AS worded FROM w GROUP BY run",
    "lru_overflow": f"""WITH f AS (SELECT source || '/' || lang AS cache, doc_id AS id, {rec("'at'", 'CAST(doc_id AS VARCHAR)')} AS "at", CAST(length(text) AS BIGINT) AS bytes FROM documents), h AS (SELECT *, sum(bytes) OVER w AS held, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY cache ORDER BY "at" DESC, id DESC)) SELECT cache, id, "at", bytes FROM h WHERE held > 10000 AND k > 1""",
    "history_recent": "WITH q AS (SELECT trim(array_to_string(string_split(text, ' ')[1:2], ' ')) AS q, conv_id AS \"at\", turn AS id FROM conversations WHERE role = 'user'), k AS (SELECT *, row_number() OVER (PARTITION BY lower(q) ORDER BY \"at\" DESC, id DESC, q DESC) AS k FROM q WHERE contains(lower(trim(q)), 'la') AND lower(trim(q)) <> 'la') SELECT q, \"at\", id FROM k WHERE k = 1 ORDER BY \"at\" DESC, id DESC LIMIT 5",
    "history_filter": "SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'la') AND contains(lower(text), 'de') AND contains(lower(text), 'que')",
    "palette_match": "WITH r AS (SELECT p_partkey AS ord, p_name AS label, CASE WHEN starts_with(lower(p_name), 'small') THEN 0 WHEN contains(lower(p_name), 'small') THEN 1 ELSE 2 END AS rank FROM part WHERE contains(lower(p_name || ' ' || p_type), 'small')) SELECT ord, label, rank FROM r ORDER BY rank, ord LIMIT 40",
    "export_tsv": f"SELECT p_partkey, concat_ws(chr(9), replace({_ODD}, chr(9), ' '), p_brand, p_type, CAST(p_size AS VARCHAR)) AS line FROM part",
    "export_csv": f"""WITH o AS (SELECT *, {_ODD} AS o FROM part) SELECT p_partkey, concat_ws(',', CASE WHEN contains(o, '"') THEN '"' || replace(o, '"', '""') || '"' ELSE o END, p_brand, p_type, CAST(p_size AS VARCHAR)) || chr(13) || chr(10) AS line FROM o""",
    "export_markdown": f"SELECT p_partkey, '| ' || concat_ws(' | ', replace({_ODD}, '|', '\\|'), p_brand, p_type, CAST(p_size AS VARCHAR)) || ' |' AS line FROM part",
    "citations": f"""WITH {PAGES}, f AS (SELECT *, string_split(text, chr(10))[1] AS first FROM pg), s AS (SELECT *, trim(regexp_replace(lower(regexp_replace(first, '[^A-Za-z0-9 ]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS flat FROM f)
SELECT doc_id, book || ', p.' || CAST(page AS VARCHAR) || CASE WHEN page % 2 = 0 THEN ' (part ' || CAST(CAST(ceil(page / 5.0) AS BIGINT) AS VARCHAR) || ')' ELSE '' END AS citation,
CASE WHEN length(first) <= 24 THEN first ELSE substring(first, 1, 12) || '…' || right(first, 11) END AS line, replace(CASE WHEN length(flat) <= 40 THEN flat ELSE regexp_replace(substring(flat, 1, 41), '\\s*\\S*$', '') END, ' ', '-') AS stem FROM s""",
}
