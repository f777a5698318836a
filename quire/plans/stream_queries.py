"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.plans.answer_queries import rec, recorded
from quire.plans.table_queries import _EV
from quire.session import shared_folder
from quire.sources import shelf
from quire.streaming import follow, runs


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a file stream, a file a batch."""
    schema = shelf.table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    day = F.to_date("ts").cast("string")
    return e.select(F.concat_ws("/", F.col("user_id").cast("string"), day).alias("run"), "event_id", "event_type", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("dollars"), (F.get_json_object("props", "$.k").cast("int") % 4 != 0).alias("sent"))


def stream_run_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run as the streaming fold leaves it: its last update, and all it was charged."""
    updates = runs.charges(runs.run_to_end(spark, runs.fold(_stream(spark, sf_dir))))
    last = updates.groupBy("run").agg(F.max_by(F.struct("lines", "errors", "last"), "batch").alias("u"), F.sum("more").alias("charged"))
    return last.select("run", "u.lines", "u.errors", "u.last", "charged")


def _pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, T.StructType]:
    """``events`` as NDJSON of their runs, each line cut in its middle: a piece is the rest of an event's line and the first half of the next one's.
    The last line of every seventh run is never finished."""
    e = shelf.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair]), F.col("event_type"))
    kind = F.when((kind == "end") & (k % 3 > 0), "log").otherwise(kind)
    spent = F.when((kind != "beat") & (k % 4 != 0), F.floor(F.col("value") * 100 + 0.5).cast("long"))
    error = F.when(kind == "end", F.when(k % 2 == 0, "stopped")).when(F.col("event_type") == "error", "no answer")
    line = F.to_json(F.struct(kind.alias("type"), F.concat(F.lit("p."), F.col("event_id").cast("string")).alias("line"), spent.alias("spent"), error.alias("error")))
    rows = e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("run"), "event_id", F.col("ts").cast("timestamp").alias("ts"), line.alias("line"))
    order = Window.partitionBy("run").orderBy("event_id")
    half = F.floor(F.length("line") / 2).cast("int")
    cut = rows.withColumns({"seq": F.row_number().over(order).cast("long"), "head": F.substring("line", F.lit(1), half), "tail": F.substring("line", half + 1, F.length("line"))})
    last = F.lead("event_id").over(order).isNull()
    broken = last & (recorded("unfinished", F.col("run")) % 7 == 0)
    piece = F.concat(F.when(F.col("seq") == 1, F.col("head")).otherwise(""), "tail", F.when(broken, "").otherwise("\n"), F.coalesce(F.lead("head").over(order), F.lit("")))
    out = cut.select("run", "seq", "ts", piece.alias("piece"))
    return out, out.schema


PARTS, QUIET = 6, 3 * 24 * 3600


def stream_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run as it stands when all pieces are there: written to a folder in the order of time, then followed a file group a batch."""
    pieces, schema = _pieces(spark, sf_dir)
    folder = shared_folder(spark)
    ends = pieces.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.unix_micros("a").alias("a"), F.unix_micros("b").alias("b")).head()
    part = F.floor((F.unix_micros("ts") - F.lit(ends.a or 0)) * PARTS / F.lit((ends.b or 0) - (ends.a or 0) + 1))
    held = shared_folder(spark)
    pieces.withColumn("part", part).write.partitionBy("part").parquet(held)
    for i in range(PARTS):  # files come one after the other, as a running server writes them
        spark.read.schema(schema).parquet(f"{held}/part={i}").coalesce(1 if i % 2 else 2).write.mode("append").parquet(folder)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return follow.standing(follow.followed(spark, live, QUIET))


_KINDS = {"signup": "start", "purchase": "end", "error": "log", "view": "log", "click": "trying"}
QUERIES = {"stream_run_fold": stream_run_fold, "stream_follow": stream_follow}
ORACLE = {"stream_run_fold": f"WITH {_EV} SELECT run, count(*) AS lines, count(*) FILTER (event_type = 'error') AS errors, arg_max(event_type, event_id) AS last, coalesce(max(dollars) FILTER (sent), 0) AS charged FROM ev GROUP BY run",
    "stream_follow": f"""WITH e0 AS (SELECT CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run, event_id, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, value FROM events),
e1 AS (SELECT *, CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'trying' WHEN 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'end' ELSE 'log' END ELSE 'log' END AS kind,
  lead(event_id) OVER (PARTITION BY run ORDER BY event_id) IS NULL AS last, max(ts) OVER () AS now FROM e0),
e2 AS (SELECT *, min(CASE WHEN kind = 'end' AND NOT broken THEN event_id END) OVER (PARTITION BY run) AS ended, max(ts) OVER (PARTITION BY run) AS latest FROM (SELECT *, last AND {rec("'unfinished'", 'run')} % 7 = 0 AS broken FROM e1)),
e3 AS (SELECT * FROM e2 WHERE NOT broken AND (ended IS NULL OR event_id <= ended)),
g AS (SELECT run, count(*) FILTER (kind = 'log') AS lines, count(*) FILTER (kind = 'log' AND event_type = 'error') AS errors, coalesce(max(CASE WHEN k % 4 <> 0 THEN CAST(floor(value * 100 + 0.5) AS BIGINT) END), 0) AS charged,
  arg_max(kind, event_id) FILTER (kind IN ('log', 'trying')) AS shown, arg_max(event_id, event_id) FILTER (kind IN ('log', 'trying')) AS at_event, max(k) FILTER (kind = 'end') AS end_k FROM e3 GROUP BY run),
u AS (SELECT run, any_value(ended) AS ended, any_value(latest) AS latest, any_value(now) AS now FROM e2 GROUP BY run),
s AS (SELECT u.run, coalesce(lines, 0) AS lines, coalesce(errors, 0) AS errors, coalesce(charged, 0) AS charged, shown, at_event,
  CASE WHEN ended IS NOT NULL THEN CASE WHEN end_k % 2 = 0 THEN 'stopped' ELSE 'done' END WHEN latest + INTERVAL 3 DAY <= now - INTERVAL 1 HOUR THEN 'left' ELSE 'running' END AS status FROM u LEFT JOIN g USING (run))
SELECT run, lines, errors, CASE WHEN status = 'running' AND shown = 'trying' THEN 'p.' || CAST(at_event AS VARCHAR) END AS trying, status, charged FROM s""",
}
