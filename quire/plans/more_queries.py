"""Queries of the smaller operators: validation, matching, heats, reports, history, spend, display."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import numbers
from quire.functions.text import STOPWORDS, normalize, quantised, sentences
from quire.operators import decide, evaluate, export, outline, runlog, tables, windows
from quire.plans._q import PAGES, documents, norm, paged, q6
from quire.plans.answer_queries import _CLAIMS, _claims, rec, recorded
from quire.plans.outline_queries import _RANGES, _ranges
from quire.plans.search_queries import question_words
from quire.plans.table_queries import _EV, _events
from quire.sources import shelf


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shelf.table(spark, sf_dir, name)


def _s(c: str):
    return F.col(c).cast("string")


def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of parts and orders spelled and read back."""
    keys = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    return keys.select("n", numbers.words_to_number(numbers.spelled(F.col("n"))).alias("read"))


def display_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", numbers.bytes_shown(F.col("o_orderkey") * 317).alias("bytes"), numbers.tokens_shown(F.col("o_orderkey") * 7).alias("tokens"))


def marks_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct boxes of an answer (an order's lines), placed by part and size."""
    li = _t(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", (F.col("l_partkey") % 5).alias("page"), (F.col("l_quantity").cast("int") % 7).alias("x0"), (F.col("l_suppkey") % 3).alias("y0")).dropDuplicates(["l_orderkey", "page", "x0", "y0"])


def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report a book: answered, below the floor or unanswered, with its counts."""
    counts = _claims(spark, sf_dir).groupBy("book").agg(*[F.count_if(F.col("text") == w).alias(n) for w, n in (("true", "yes"), ("false", "no"), ("not stated", "open"))])
    status = F.when(F.col("yes") > 5, "answered").when(F.col("no") > 0, "below").otherwise("unanswered")
    return counts.select("book", F.to_json(F.struct("book", status.alias("status"), "yes", "no", "open")).alias("report"))


def ranked_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as ranked lines: score in hundredths, a tab, the name elided to 14."""
    p = _t(spark, sf_dir, "part")
    score = F.concat(F.lit("0."), F.lpad((recorded("r", _s("p_partkey")) % 100).cast("string"), 2, "0"))
    return p.select("p_partkey", F.concat_ws("\t", score, export.elide(F.concat_ws(" ", "p_name", "p_brand"), 14)).alias("line"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paged(spark, sf_dir).select("doc_id", F.concat(F.lit("file:///shelf/"), "book", F.lit(".pdf#page="), _s("page")).alias("link"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each claim: the verdict for short ones, else the passage cut at 60."""
    docs = paged(spark, sf_dir).join(_claims(spark, sf_dir).select("book", "page", F.col("text").alias("verdict")), ["book", "page"])
    flat = F.regexp_replace(F.trim(F.col("text")), r"\s+", " ")
    return docs.select("doc_id", F.when(F.col("verdict") != "not stated", F.initcap("verdict")).when(F.length(flat) > 60, F.concat(F.substring(flat, 1, 59), F.lit("…"))).otherwise(flat).alias("line"))


#: Options: name, kind, default, least, most, the tools they are for.
_OPTIONS = [("threshold", "number", 70, 0, 100, "find sec"), ("hits", "whole", 1, 1, 50, "find sec"), ("top", "whole", 20, 1, 500, "grep"), ("floor", "number", 15, 0, 30, "find grep")]


def _options(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *o) for i, o in enumerate(_OPTIONS)], "ord int, name string, kind string, standard int, least int, most int, tools string")


_OPT_SQL = "op(ord, name, kind, standard, least, most, tools) AS (VALUES " + ", ".join(f"({i}, '{n}', '{k}', {d}, {a}, {b}, '{t}')" for i, (n, k, d, a, b, t) in enumerate(_OPTIONS)) + ")"
_REQ_SQL = f"""{_OPT_SQL}, rq AS (SELECT o_orderkey AS id, ['grep', 'sec', 'find'][o_orderkey % 3 + 1] AS tool, op.*, {rec("'opt'", 'name', 'CAST(o_orderkey AS VARCHAR)')} AS value FROM orders, op)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded option values of one request an order; the tool goes by the key. The options are a fixed list of four."""
    tool = F.element_at(F.array(F.lit("grep"), F.lit("sec"), F.lit("find")), (F.col("id") % 3 + 1).cast("int"))
    met = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(F.broadcast(_options(spark)))
    return met.withColumns({"tool": tool, "value": recorded("opt", F.col("name"), _s("id"))})


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule, in the options' order, that a request breaks."""
    r = _requests(spark, sf_dir)
    foul = F.when(~F.contains("tools", "tool"), F.concat("name", F.lit(" is not for "), "tool")).when((F.col("value") < F.col("least")) | (F.col("value") > F.col("most")), F.concat("name", F.lit(" is out of range"))).when((F.col("kind") == "whole") & (F.col("value") % 7 == 0), F.concat("name", F.lit(" must be whole")))
    first = r.withColumn("foul", foul).where("foul is not null").groupBy("id").agg(F.min(F.struct("ord", "foul")).alias("b"))
    return r.select("id").distinct().join(first, "id", "left").select("id", F.coalesce("b.foul", F.lit("ok")).alias("result"))


def changed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's flags: options for its tool that differ from their defaults, in order."""
    r = _requests(spark, sf_dir).where(F.contains("tools", "tool") & (F.col("value") != F.col("standard")))
    flags = r.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("--"), "name", F.lit("="), _s("value")).alias("f")))).alias("f"))
    return flags.select("id", F.array_join(F.transform("f", lambda x: x["f"]), " ").alias("flags"))


def offer_afresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a cached search should be offered anew: the cache on and its budgets used up."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", (recorded("cache", _s("c_custkey")) % 2 == 1).alias("cached"), (recorded("read", _s("c_custkey")) % 16).alias("sections"), (recorded("kept", _s("c_custkey")) % 7).alias("kept"))
    return c.withColumn("offer", F.col("cached") & ((F.col("sections") >= 12) | (F.col("kept") >= 5)))


def match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's suppliers to a table in which a third of them is renamed: by name, the rest by recorded answers to every free name."""
    s = _t(spark, sf_dir, "supplier")
    ours = s.select(F.col("s_nationkey").alias("tid"), F.col("s_suppkey").alias("i"), F.lower("s_name").alias("name"))
    theirs = s.select(F.col("s_nationkey").alias("tid"), F.col("s_suppkey").alias("j"), F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit("x"))).otherwise(F.col("s_name")).alias("name"))
    return tables.match_rows(ours, theirs, lambda asks: asks.withColumn("p", recorded("match", _s("i"), _s("j"))))


def question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With how many others of its label each vector makes an ordered pair: the pairs of a label are not written out."""
    return evaluate.partners(_t(spark, sf_dir, "embeddings").select("label", "vec_id"), "label")


def trace_to_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a user within the case that the last sign-up before them began."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("user"), "ts", F.col("event_id").alias("id"), "event_type")
    return runlog.within_cases(e.where("event_type = 'view'"), e.where("event_type = 'signup'"))


def passage_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the chosen lines' recorded p by document, and how many."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("p", recorded("line", _s("doc_id"), _s("pos"))).where("p >= 65")
    return lines.groupBy("doc_id").agg(quantised(F.avg("p")).alias("p"), F.count("*").alias("lines"))


def spend_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", (recorded("in", _s("o_orderkey")) * 997).cast("long").alias("tokens"), recorded("wall", _s("o_orderkey")).alias("wall"), recorded("api", _s("o_orderkey")).alias("api"), (recorded("ex", _s("o_orderkey")) % 20).alias("extract"))
    return runlog.split_spend(o).select("o_orderkey", "micros", "other")


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files opened and sections read of each run against their caps."""
    e = _events(spark, sf_dir).groupBy("run").agg(F.count_if(F.col("tool") == "view").alias("files"), F.count_if(F.col("tool") == "click").alias("sections"))
    return e.select("run", F.least("files", F.lit(2)).alias("files"), F.least("sections", F.lit(3)).alias("sections"), (F.col("files") > 2).alias("over"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as units: three to a paragraph, headed by status, every fifth part a lone note."""
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    li = _t(spark, sf_dir, "lineitem").withColumn("pos", pos)
    return li.select("l_orderkey", "pos", F.floor((F.col("pos") - 1) / 3).alias("para"), F.col("l_linestatus").alias("heads"), (F.col("l_partkey") % 5 == 0).alias("lone"), recorded("unit", _s("l_orderkey"), _s("pos")).alias("p"), _s("l_partkey").alias("text"))


_UNITS = f"""u0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem),
un AS (SELECT l_orderkey, pos, (pos - 1) // 3 AS para, l_linestatus AS heads, l_partkey % 5 = 0 AS lone, {rec("'unit'", 'CAST(l_orderkey AS VARCHAR)', 'CAST(pos AS VARCHAR)')} AS p, CAST(l_partkey AS VARCHAR) AS text FROM u0)"""


def notes_with_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.notes_with_rows(_units(spark, sf_dir), "l_orderkey").select("l_orderkey", "pos", "p")


def passage_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.regrouped(_units(spark, sf_dir).withColumn("chosen", F.col("p") >= 45), "l_orderkey")


def history_remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("user"), (F.get_json_object("props", "$.k").cast("int") % 20).alias("id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("pinned"))
    return runlog.remembered(e, 8).select("user", "id", "pinned", "place")


def viewer_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = paged(spark, sf_dir).select("book", "page", "doc_id", (F.length("text") % 400 + 100).cast("long").alias("height"))
    return runlog.placed(pages, 12).select("doc_id", "top")


def viewer_page_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which page of its book a recorded scroll of each document shows, some above the first and some below the last."""
    pages = paged(spark, sf_dir).select("book", "page", "doc_id", (F.length("text") % 400 + 100).cast("long").alias("height"))
    tops = runlog.placed(pages, 12).select("book", "page", "top")
    probes = pages.select("doc_id", "book", (recorded("y", _s("doc_id")) * 211 - 300).cast("long").alias("y"))
    return runlog.page_at(tops, probes).select("doc_id", "y", "page")


def coarse_to_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two best chapters of each book by recorded score, then everything under them by score: two stages of top k."""
    r = _ranges(spark, sf_dir).withColumn("score", recorded("rank", F.col("book"), F.col("path")))
    best = r.where("depth = 1").withColumn("k", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("score"), "path"))).where("k <= 2")
    fine = best.drop("k").unionByName(outline.under(r, best.select("book", "path")))
    return fine.withColumn("rank", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("score"), "path"))).where("rank <= 12").select("book", "path", "score", "rank")


def unread_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that no recorded walk has read: an anti-join."""
    pages = paged(spark, sf_dir).select("book", "page", "doc_id")
    read = pages.where(recorded("read", _s("doc_id")) < 60).select("book", "page")
    return pages.join(read, ["book", "page"], "left_anti").select("doc_id")


def merged_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores of scores as one, the newer store winning where both have a key."""
    c = _t(spark, sf_dir, "customer").select("c_custkey")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", F.lit(0).alias("store"), recorded("old", _s("c_custkey")).alias("v"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit(1).alias("store"), recorded("new", _s("c_custkey")).alias("v"))
    return old.unionAll(new).groupBy("c_custkey").agg(F.max_by("v", "store").alias("v"), F.max("store").alias("store"))


def list_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of a part's words with values for the ones that are colours."""
    values = F.create_map(*[F.lit(x) for kv in (("red", "1"), ("blue", "2"), ("small", "s"), ("gear", "cog")) for x in kv])
    items = F.concat(F.regexp_replace("p_name", " ", ", "), F.when(F.col("p_partkey") % 4 == 0, ", n/a").otherwise(""))
    return _t(spark, sf_dir, "part").select("p_partkey", tables.with_values(items, values).alias("text"))


def entry_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" has no value"))).otherwise(F.concat_ws(": ", "p_name", "p_type"))
    out = _t(spark, sf_dir, "part").select("p_partkey", tables.entry_pieces(line).alias("e")).where("e is not null")
    return out.select("p_partkey", "e.label", "e.value")


def parsed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns written as log lines and parsed again."""
    c = _t(spark, sf_dir, "conversations")
    cost = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" ["), _s("conv_id"), F.lit(" in, "), _s("turn"), F.lit(" out]"))).otherwise(F.when(F.col("turn") % 3 == 0, F.lit("…")).otherwise(""))
    line = F.concat(F.repeat(F.lit("  "), (F.col("turn") % 4).cast("int")), "role", F.lit(" said"), cost)
    return c.select("conv_id", "turn", runlog.parsed(line).alias("x")).select("conv_id", "turn", "x.*")


class Digest:
    """Answers in hundredths that a digest of the call and the option gives; the first ``off`` are taken as none."""

    def __init__(self, salt: str, off: int = 0):
        self.salt, self.off = salt, off

    def answers(self, asks: DataFrame) -> DataFrame:
        return asks.select("ask_id", "option", "pos", (F.greatest(recorded(self.salt, F.col("ask_id"), F.col("option")) - self.off, F.lit(0)) / 100).alias("p"))


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's parts as options, by key."""
    a = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("ask_id"), _s("p_partkey").alias("option"), F.col("p_partkey").alias("pos"), F.lit("which one").alias("instruction"), F.lit("").alias("state"))
    return a.withColumn("pos", F.row_number().over(Window.partitionBy("ask_id").orderBy("pos")) - 1)


def tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice of each brand, by heats of 15 and finals that are asked anew."""
    return decide.tournament(_choices(spark, sf_dir), Digest("heat")).select("ask_id", "option", "p", "rounds")


def choice_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's parts ranked by choices of at most 40, again without the picks until 12 are ranked; a fifth of the answers is not nothing."""
    out = decide.ranked_by_choice(_choices(spark, sf_dir), Digest("rounds", 95), most=40)
    return out.select("ask_id", "option", "rank", "round", quantised(F.col("score")).alias("score"), "p")


def score_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected level and confidence over four recorded levels."""
    level = F.explode(F.sequence(F.lit(0), F.lit(3)))
    a = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ask_id"), level.alias("pos")).withColumn("w", recorded("level", _s("ask_id"), _s("pos")) + 1)
    a = a.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("ask_id")))
    return decide.score(a).select("ask_id", quantised(F.col("score")).alias("score"), quantised(F.col("confidence")).alias("confidence"))


def asked_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers near 0.7 averaged with two more readings."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ask_id"), F.lit("yes").alias("option"), F.lit(0).alias("pos"))
    first = c.withColumn("p", recorded("a0", _s("ask_id")) / 100)
    again = c.select("ask_id", "option", F.explode(F.array(recorded("a1", _s("ask_id")) / 100, recorded("a2", _s("ask_id")) / 100)).alias("p"))
    return decide.asked_again(first, 0.7, 0.1, again).select("ask_id", quantised(F.col("p")).alias("p"))


def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' results by case, whichever has it."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case"))
    a = c.where("case % 3 <> 0").select("case", recorded("x", _s("case")).alias("a"))
    b = c.where("case % 4 <> 0").select("case", recorded("y", _s("case")).alias("b"))
    return a.join(b, "case", "full").select("case", F.coalesce(F.col("a"), F.lit(-1)).alias("a"), F.coalesce(F.col("b"), F.lit(-1)).alias("b"))


def repeatability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of five readings a customer and how many pass."""
    r = _t(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).withColumn("p", recorded("again", _s("c_custkey"), _s("k")))
    return r.groupBy("c_custkey").agg(F.min("p").alias("least"), F.max("p").alias("most"), F.count_if(F.col("p") >= 50).alias("passed"))


def bar_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped rows and lost good ones at each bar: counts by value, then a running sum."""
    lab = _t(spark, sf_dir, "labels").select(recorded("value", _s("doc_id")).alias("value"), (F.col("quality") == 1).alias("good"))
    up = evaluate.sweep(lab.select((100 - F.col("value")).alias("value"), "good"))
    return up.select((101 - F.col("value")).cast("int").alias("bar"), F.col("taken").alias("dropped"), F.col("tp").alias("lost"))


def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "unit"))
    return rows.select("doc_id", "pos", F.length("unit").alias("chars"), F.md5("unit").alias("digest"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = question_words(spark, sf_dir).withColumn("word", F.when(F.col("pos") % 5 == 3, F.lit("of")).when(F.col("pos") % 11 == 4, F.lit("The")).otherwise(F.col("word")))
    return words.withColumn("p", recorded("bar", _s("item_id"), _s("pos"))).withColumns({"start": F.col("p") >= 50, "go": F.col("p") >= 30, "stop": F.lower("word").isin(*STOPWORDS)})


def two_bar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in benchmark texts from a start bar of 50 on, over words from 30 on and an "of" between two, never over other function words."""
    names = windows.names_by(_named(spark, sf_dir), "item_id", of=True)
    return names.select("item_id", "pos", "end", F.array_join("name", " ").alias("name"))


def trimmed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words from 30 on, function words inside them but not at their ends."""
    words = _named(spark, sf_dir).withColumns({"start": F.col("go"), "stop": F.lit(False)})
    names = windows.trimmed(windows.names_by(words, "item_id"), STOPWORDS)
    return names.select("item_id", "pos", "end", F.array_join("name", " ").alias("name"))


def best_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs worth showing of each document's lines, by the letters' share of each line."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    share = F.when(F.length("line") > 0, F.floor(F.length(F.regexp_replace("line", "[^a-z]", "")) * 100 / F.length("line"))).otherwise(0).cast("long")
    return windows.best_runs(lines.withColumn("share", share), "doc_id", 80)


_ALL = (sentence_units, two_bar_names, trimmed_names, best_runs, number_words, display_forms, marks_dedup, json_reports, ranked_render, page_links, run_summary, request_validation, changed_options, offer_afresh, match_rows, question_pairs, trace_to_case, passage_confidence, spend_split, gauges, notes_with_rows, passage_regroup, history_remembered, viewer_layout, viewer_page_at, coarse_to_fine, unread_pages, merged_stores, list_values, entry_pieces, parsed_log, tournament, choice_rounds, score_levels, asked_again, side_by_side, repeatability, bar_sweep)
QUERIES = {f.__name__: f for f in _ALL}


def _r(salt: str, *cols: str) -> str:
    return rec(f"'{salt}'", *[f"CAST({c} AS VARCHAR)" for c in cols])


def _heats(k: int) -> str:
    """Round ``k`` of a tournament in SQL: ``r{k}`` in, what leaves as ``o{k}`` and the rest as ``r{k + 1}``."""
    return f"""n{k} AS (SELECT *, count(*) OVER (PARTITION BY ask_id) AS n, (row_number() OVER (PARTITION BY ask_id ORDER BY pos) - 1) // 15 AS heat FROM r{k}),
h{k} AS (SELECT ask_id, heat, option, pos, {rec("'heat'", f"ask_id || '#{k}#' || CAST(heat AS VARCHAR)", 'option')} AS p FROM (SELECT ask_id, heat, option, pos FROM n{k} WHERE n > 16 UNION ALL SELECT ask_id, heat, 'none of these', max(pos) + 1 FROM n{k} WHERE n > 16 GROUP BY ALL)),
b{k} AS (SELECT *, row_number() OVER (PARTITION BY ask_id, heat ORDER BY p DESC, pos) AS best FROM h{k}),
o{k} AS (SELECT ask_id, option, {rec("'heat'", f"ask_id || '#{k}'", 'option')} / 100::DOUBLE AS p, {k} AS rounds FROM n{k} WHERE n <= 16 UNION ALL SELECT ask_id, option, 0.0::DOUBLE, {k} FROM b{k} WHERE best > 1 AND option <> 'none of these'),
r{k + 1} AS (SELECT ask_id, option, pos FROM b{k} WHERE best = 1 AND option <> 'none of these')"""


_NAMED = f"""r AS (SELECT item_id, regexp_split_to_array(trim(text), '\\s+') AS raw FROM benchmark), w AS (SELECT item_id, list_filter(list_transform(raw, lambda x: {{'word': regexp_replace(x, '[^\\w''-]', '', 'g'), 'ends': regexp_matches(x, '[,;.]$')}}), lambda s: s.word <> '') AS ws FROM r),
e AS (SELECT item_id, CAST(unnest(range(0, len(ws))) AS INTEGER) AS pos, unnest(ws) AS w FROM w),
f AS (SELECT item_id, pos, CASE WHEN pos % 5 = 3 THEN 'of' WHEN pos % 11 = 4 THEN 'The' ELSE w.word END AS word, w.ends AS ends, {rec("'bar'", 'CAST(item_id AS VARCHAR)', 'CAST(pos AS VARCHAR)')} AS p FROM e),
wd AS (SELECT *, 1 AS n, p >= 50 AS start, p >= 30 AS go, lower(word) IN ({", ".join(f"'{x}'" for x in STOPWORDS)}) AS stop FROM f)"""
ORACLE = {
    "sentence_units": "WITH m AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS m FROM documents), c AS (SELECT doc_id, regexp_replace(regexp_replace(m, '([.!?]) ([^a-z])', '\\1' || chr(1) || '\\2', 'g'), '([.!?]) ([^a-z])', '\\1' || chr(1) || '\\2', 'g') AS c FROM m), g AS (SELECT doc_id, regexp_replace(c, '(^|' || chr(1) || ')([0-9]{1,3}\\.)' || chr(1), '\\1\\2 ', 'g') AS m FROM c), l AS (SELECT doc_id, list_filter(string_split(m, chr(1)), lambda x: length(x) > 1) AS l FROM g), e AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS u FROM l) SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(length(u) AS INTEGER) AS chars, md5(u) AS digest FROM e",
    # one word after the other, as it is read
    "two_bar_names": f"""WITH RECURSIVE {_NAMED}, walk AS (
  SELECT item_id, 0 AS i, -1 AS first, -1 AS last, NULL::INTEGER AS df, NULL::INTEGER AS dl FROM wd WHERE pos = 0
  UNION ALL
  SELECT k.item_id,
    CASE WHEN first < 0 THEN i + 1 WHEN one THEN i + 1 WHEN two THEN i + 2 ELSE i END,
    CASE WHEN first < 0 THEN CASE WHEN begins THEN i ELSE -1 END WHEN one OR two THEN first ELSE -1 END,
    CASE WHEN first < 0 THEN CASE WHEN begins THEN i ELSE -1 END WHEN one THEN last + 1 WHEN two THEN last + 2 ELSE -1 END,
    CASE WHEN first >= 0 AND NOT (one OR two) THEN first END, CASE WHEN first >= 0 AND NOT (one OR two) THEN last END
  FROM (SELECT s.*, w0.n, coalesce(w0.start AND NOT w0.stop, false) AS begins, coalesce(NOT e.ends AND a.go AND NOT a.stop, false) AS one,
      coalesce(NOT e.ends AND NOT (a.go AND NOT a.stop) AND lower(a.word) = 'of' AND b.go AND NOT b.stop, false) AS two
    FROM walk s LEFT JOIN wd w0 ON w0.item_id = s.item_id AND w0.pos = s.i LEFT JOIN wd e ON e.item_id = s.item_id AND e.pos = s.last LEFT JOIN wd a ON a.item_id = s.item_id AND a.pos = s.last + 1 LEFT JOIN wd b ON b.item_id = s.item_id AND b.pos = s.last + 2) k
  WHERE k.n IS NOT NULL OR first >= 0)
SELECT w.item_id, df AS pos, dl AS "end", string_agg(word, ' ' ORDER BY wd.pos) AS name FROM walk w JOIN wd ON wd.item_id = w.item_id AND wd.pos BETWEEN df AND dl WHERE df IS NOT NULL GROUP BY ALL""",
    "trimmed_names": f"""WITH {_NAMED}, b AS (SELECT *, go AND NOT coalesce(lag(go AND NOT ends) OVER (PARTITION BY item_id ORDER BY pos), false) AS new FROM wd),
rr AS (SELECT *, sum(new::INT) OVER (PARTITION BY item_id ORDER BY pos) AS run FROM b WHERE go),
t AS (SELECT *, min(CASE WHEN NOT stop THEN pos END) OVER (PARTITION BY item_id, run) AS a, max(CASE WHEN NOT stop THEN pos END) OVER (PARTITION BY item_id, run) AS z FROM rr)
SELECT item_id, min(pos) AS pos, max(pos) AS "end", string_agg(word, ' ' ORDER BY pos) AS name FROM t WHERE pos BETWEEN a AND z GROUP BY item_id, run""",
    "number_words": "SELECT o_orderkey AS n, o_orderkey AS read FROM orders",
    "display_forms": "WITH o AS (SELECT o_orderkey, o_orderkey * 317 AS b, o_orderkey * 7 AS t FROM orders) SELECT o_orderkey, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN CAST(b // 1024 AS VARCHAR) || ' KB' ELSE CAST(b // 1048576 AS VARCHAR) || ' MB' END AS bytes, CASE WHEN t < 1000 THEN CAST(t AS VARCHAR) ELSE CAST(t // 1000 AS VARCHAR) || '.' || CAST(t % 1000 // 100 AS VARCHAR) || 'k' END AS tokens FROM o",
    "marks_dedup": "SELECT DISTINCT l_orderkey, l_partkey % 5 AS page, CAST(trunc(l_quantity) AS INTEGER) % 7 AS x0, l_suppkey % 3 AS y0 FROM lineitem",
    "json_reports": f"WITH {_CLAIMS}, c AS (SELECT book, count(*) FILTER (text = 'true') AS yes, count(*) FILTER (text = 'false') AS no, count(*) FILTER (text = 'not stated') AS open FROM cv GROUP BY book) SELECT book, '{{\"book\":\"' || book || '\",\"status\":\"' || CASE WHEN yes > 5 THEN 'answered' WHEN no > 0 THEN 'below' ELSE 'unanswered' END || '\",\"yes\":' || CAST(yes AS VARCHAR) || ',\"no\":' || CAST(no AS VARCHAR) || ',\"open\":' || CAST(open AS VARCHAR) || '}}' AS report FROM c",
    "ranked_render": f"WITH n AS (SELECT p_partkey, p_name || ' ' || p_brand AS n, {_r('r', 'p_partkey')} % 100 AS s FROM part) SELECT p_partkey, '0.' || lpad(CAST(s AS VARCHAR), 2, '0') || chr(9) || CASE WHEN length(n) <= 14 THEN n ELSE substring(n, 1, 7) || '…' || right(n, 6) END AS line FROM n",
    "page_links": f"WITH {PAGES} SELECT doc_id, 'file:///shelf/' || book || '.pdf#page=' || CAST(page AS VARCHAR) AS link FROM pg",
    "run_summary": f"WITH {_CLAIMS}, f AS (SELECT doc_id, cv.text AS verdict, regexp_replace(trim(pg.text), '\\s+', ' ', 'g') AS f FROM pg JOIN cv USING (book, page)) SELECT doc_id, CASE WHEN verdict = 'true' THEN 'True' WHEN verdict = 'false' THEN 'False' WHEN length(f) > 60 THEN substring(f, 1, 59) || '…' ELSE f END AS line FROM f",
    "request_validation": f"WITH {_REQ_SQL}, b AS (SELECT id, ord, CASE WHEN NOT contains(tools, tool) THEN name || ' is not for ' || tool WHEN value < least OR value > most THEN name || ' is out of range' WHEN kind = 'whole' AND value % 7 = 0 THEN name || ' must be whole' END AS foul FROM rq) SELECT id, coalesce(arg_min(foul, ord) FILTER (foul IS NOT NULL), 'ok') AS result FROM b GROUP BY id",
    "changed_options": f"WITH {_REQ_SQL} SELECT id, string_agg('--' || name || '=' || CAST(value AS VARCHAR), ' ' ORDER BY ord) AS flags FROM rq WHERE contains(tools, tool) AND value <> standard GROUP BY id",
    "offer_afresh": f"WITH c AS (SELECT c_custkey, {_r('cache', 'c_custkey')} % 2 = 1 AS cached, {_r('read', 'c_custkey')} % 16 AS sections, {_r('kept', 'c_custkey')} % 7 AS kept FROM customer) SELECT *, cached AND (sections >= 12 OR kept >= 5) AS offer FROM c",
    "match_rows": f"""WITH o AS (SELECT s_nationkey AS tid, s_suppkey AS i, {norm('s_name')} AS k FROM supplier), t AS (SELECT s_nationkey AS tid, s_suppkey AS j, {norm("CASE WHEN s_suppkey % 3 = 0 THEN s_name || 'x' ELSE s_name END")} AS k FROM supplier),
s AS (SELECT o.tid, i, max(j) AS j FROM o LEFT JOIN t ON t.tid = o.tid AND t.k = o.k GROUP BY o.tid, i), fr AS (SELECT tid, j FROM t WHERE (tid, j) NOT IN (SELECT tid, j FROM s WHERE j IS NOT NULL)),
a AS (SELECT s.tid, i, fr.j, {_r('match', 'i', 'fr.j')} AS p FROM s JOIN fr ON fr.tid = s.tid WHERE s.j IS NULL)
SELECT tid, i, j, CAST(100 AS INTEGER) AS p FROM s WHERE j IS NOT NULL UNION ALL SELECT tid, i, j, p FROM a WHERE p >= 50 QUALIFY row_number() OVER (PARTITION BY tid, i ORDER BY p DESC, j) = 1""",
    "question_pairs": "SELECT label, vec_id, count(*) OVER (PARTITION BY label) - 1 AS partners FROM embeddings",
    "trace_to_case": "WITH v AS (SELECT user_id AS \"user\", event_id AS id, ts FROM events WHERE event_type = 'view') SELECT \"user\", id, (SELECT arg_max(c.event_id, (c.ts, c.event_id)) FROM events c WHERE c.event_type = 'signup' AND c.user_id = v.\"user\" AND c.ts <= v.ts) AS \"case\" FROM v",
    "passage_confidence": f"WITH l AS (SELECT doc_id, unnest(range(0, len(p))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)), r AS (SELECT doc_id, {_r('line', 'doc_id', 'pos')} AS p FROM l) SELECT doc_id, {q6('avg(p)')} AS p, count(*) AS lines FROM r WHERE p >= 65 GROUP BY doc_id",
    "spend_split": f"SELECT o_orderkey, CAST(floor(CAST({_r('in', 'o_orderkey')} * 997 AS BIGINT) * 42 / 1000) AS BIGINT) AS micros, greatest(0, {_r('wall', 'o_orderkey')} - {_r('api', 'o_orderkey')} - {_r('ex', 'o_orderkey')} % 20) AS other FROM orders",
    "gauges": f"WITH {_EV}, g AS (SELECT run, count(*) FILTER (tool = 'view') AS f, count(*) FILTER (tool = 'click') AS s FROM ev GROUP BY run) SELECT run, least(f, 2) AS files, least(s, 3) AS sections, f > 2 AS over FROM g",
    "notes_with_rows": f"WITH {_UNITS} SELECT l_orderkey, CAST(pos AS INTEGER) AS pos, CASE WHEN lone AND NOT coalesce(lag(lone) OVER w, true) AND lag(heads) OVER w = heads THEN greatest(p, lag(p) OVER w) ELSE p END AS p FROM un WINDOW w AS (PARTITION BY l_orderkey ORDER BY pos)",
    "passage_regroup": f"""WITH {_UNITS}, c AS (SELECT *, lag(pos) OVER w AS lp, lag(para) OVER w AS la FROM un WHERE p >= 45 WINDOW w AS (PARTITION BY l_orderkey ORDER BY pos)), m AS (SELECT *, coalesce(lp <> pos - 1, true) AS apart FROM c),
r AS (SELECT *, sum(CASE WHEN apart OR la <> para THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY pos) AS run FROM m)
SELECT l_orderkey, CAST(run AS BIGINT) AS run, min(para) AS para, arg_min(apart, pos) AND run > 1 AS gap, string_agg(text, ' ' ORDER BY pos) AS text FROM r GROUP BY l_orderkey, run""",
    "history_remembered": """WITH e AS (SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS id, ts, event_id, event_type = 'purchase' AS pinned FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY "user", id ORDER BY ts DESC, event_id DESC) AS k FROM e),
c AS (SELECT *, sum(CASE WHEN pinned THEN 0 ELSE 1 END) OVER (PARTITION BY "user" ORDER BY ts DESC, event_id DESC) AS n FROM n WHERE k = 1)
SELECT "user", id, pinned, CAST(row_number() OVER (PARTITION BY "user" ORDER BY pinned DESC, ts DESC, event_id DESC) AS INTEGER) AS place FROM c WHERE pinned OR n <= 8""",
    "viewer_page_at": f"""WITH {PAGES}, t AS (SELECT book, page, doc_id, coalesce(sum(length(text) % 400 + 112) OVER (PARTITION BY book ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM pg),
y AS (SELECT doc_id, book, CAST({_r('y', 'doc_id')} * 211 - 300 AS BIGINT) AS y FROM pg) SELECT y.doc_id, y, CAST(coalesce(max(page) FILTER (top <= y), 1) AS INTEGER) AS page FROM y JOIN t USING (book) GROUP BY y.doc_id, y""",
    "viewer_layout": f"WITH {PAGES} SELECT doc_id, CAST(coalesce(sum(length(text) % 400 + 112) OVER (PARTITION BY book ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS top FROM pg",
    "coarse_to_fine": f"""WITH {_RANGES}, s AS (SELECT *, {rec("'rank'", 'book', 'path')} AS score FROM rg), b AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY score DESC, path) AS k FROM s WHERE depth = 1),
f AS (SELECT s.* FROM s WHERE EXISTS (SELECT 1 FROM b WHERE b.k <= 2 AND b.book = s.book AND (b.path = s.path OR starts_with(s.path, b.path || ' > ')))), r AS (SELECT book, path, score, CAST(row_number() OVER (PARTITION BY book ORDER BY score DESC, path) AS INTEGER) AS rank FROM f) SELECT * FROM r WHERE rank <= 12""",
    "unread_pages": f"SELECT doc_id FROM documents WHERE {_r('read', 'doc_id')} >= 60",
    "merged_stores": f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN {_r('new', 'c_custkey')} ELSE {_r('old', 'c_custkey')} END AS v, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS store FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0",
    "list_values": """WITH w AS (SELECT p_partkey, unnest(range(0, 3)) AS i, unnest([string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], CASE WHEN p_partkey % 4 = 0 THEN 'n/a' END]) AS x FROM part)
SELECT p_partkey, string_agg(CASE WHEN x = 'n/a' THEN x ELSE x || ' (' || CASE lower(x) WHEN 'red' THEN '1' WHEN 'blue' THEN '2' WHEN 'small' THEN 's' WHEN 'gear' THEN 'cog' ELSE 'N/A' END || ')' END, ', ' ORDER BY i) AS text FROM w WHERE x IS NOT NULL GROUP BY p_partkey""",
    "entry_pieces": "SELECT p_partkey, p_name AS label, p_type AS value FROM part WHERE p_partkey % 3 <> 0",
    "parsed_log": "SELECT conv_id, turn, CAST(turn % 4 AS INTEGER) AS depth, role || ' said' || CASE WHEN turn % 2 <> 0 AND turn % 3 = 0 THEN '…' ELSE '' END AS text, CASE WHEN turn % 2 = 0 THEN conv_id ELSE 0 END AS tokens_in, CASE WHEN turn % 2 = 0 THEN turn ELSE 0 END AS tokens_out, turn % 2 <> 0 AND turn % 3 = 0 AS header FROM conversations",
    "tournament": f"""WITH r1 AS (SELECT p_brand AS ask_id, CAST(p_partkey AS VARCHAR) AS option, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part), {', '.join(_heats(k) for k in range(1, 6))},
o AS ({' UNION ALL '.join(f'SELECT * FROM o{k}' for k in range(1, 6))}) SELECT ask_id, option, p, rounds FROM o""",
    "score_levels": f"WITH a AS (SELECT p_partkey AS ask_id, unnest([0, 1, 2, 3]) AS pos FROM part), w AS (SELECT *, {_r('level', 'ask_id', 'pos')} + 1 AS w FROM a), p AS (SELECT ask_id, pos, w / CAST(sum(w) OVER (PARTITION BY ask_id) AS DOUBLE) AS p FROM w) SELECT ask_id, {q6('sum(pos * p)')} AS score, {q6('max(p)')} AS confidence FROM p GROUP BY ask_id",
    "asked_again": f"WITH a AS (SELECT c_custkey AS ask_id, {_r('a0', 'c_custkey')} / 100::DOUBLE AS p0, {_r('a1', 'c_custkey')} / 100::DOUBLE AS p1, {_r('a2', 'c_custkey')} / 100::DOUBLE AS p2 FROM customer) SELECT ask_id, {q6('CASE WHEN abs(p0 - 0.7::DOUBLE) <= 0.1::DOUBLE THEN (p0 + (p1 + p2)) / 3 ELSE p0 END')} AS p FROM a",
    "side_by_side": f"SELECT c_custkey AS \"case\", CASE WHEN c_custkey % 3 <> 0 THEN {_r('x', 'c_custkey')} ELSE -1 END AS a, CASE WHEN c_custkey % 4 <> 0 THEN {_r('y', 'c_custkey')} ELSE -1 END AS b FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 4 <> 0",
    "repeatability": f"WITH k AS (SELECT c_custkey, unnest([1, 2, 3, 4, 5]) AS k FROM customer), r AS (SELECT c_custkey, {_r('again', 'c_custkey', 'k')} AS p FROM k) SELECT c_custkey, min(p) AS least, max(p) AS most, count(*) FILTER (p >= 50) AS passed FROM r GROUP BY c_custkey",
    "bar_sweep": f"WITH l AS (SELECT {_r('value', 'doc_id')} AS value, quality = 1 AS good FROM labels), g AS (SELECT value, count(*) AS n, count(*) FILTER (good) AS g FROM l GROUP BY value) SELECT CAST(value + 1 AS INTEGER) AS bar, CAST(sum(n) OVER (ORDER BY value) AS BIGINT) AS dropped, CAST(sum(g) OVER (ORDER BY value) AS BIGINT) AS lost FROM g",
}
