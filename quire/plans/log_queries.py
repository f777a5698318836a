"""What logs say was read. The logs are written from conversations, ten to a run: a turn is a line whose form a digest of it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import logwalk
from quire.plans.answer_queries import recorded
from quire.sources import shelf


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = shelf.table(spark, sf_dir, "conversations")
    n = lambda salt, most: (recorded(salt, F.col("conv_id").cast("string"), F.col("turn").cast("string")) % most).cast("string")
    score = F.concat(F.lit("0."), F.lpad(n("p", 100), 2, "0"))
    word, page = F.concat(F.lit("Part "), n("word", 3)), n("page", 4)
    pick = recorded("form", F.col("conv_id").cast("string"), F.col("turn").cast("string")) % 16
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    verb = F.element_at(F.array(F.lit("take"), F.lit("keep"), F.lit("drop")), recorded("verb", F.col("conv_id").cast("string"), F.col("turn").cast("string")) % 3 + 1)
    forms = [
        (0, say("ranked ", n("n", 30), " paths and 2 excerpts in 0.2s (model 0.2s), ", n("k", 9), " above file floor 1.5")), (0, say("2.", page, "0  /shelf/", word, ".pdf…")), (0, say("2.", page, "0  /shelf/", word, ".pdf  (by p.3)…")),
        (0, say("1.", page, "0  /shelf/", word, ".pdf  --  no such file, skipped")), (1, say("ranked ", n("s", 3), " sections and ", n("e", 3), " excerpts in 0.1s")), (1, say("section ", word, "  p.", page, "-", page, "…")),
        (1, say("section ", word, "  p.", page, "-9…")), (2, say("yes  ", score, "  ", word, " p.", page)), (2, say("no   ", score, "  0.2s model  ", word, " p.", page)), (2, say(verb, "  ", n("a", 50), " (p=", score, ")  ", word, " p.", page)),
        (2, say(verb, "  Lift the lid… (p=", score, ")  ", word, " p.", page, " (excerpt)")), (1, say("excerpt  yes  ", score, "  ", word, " p.", page, " (excerpt)…")), (1, say("excerpt  no   ", score, "  p.", page, " p.", page, " (excerpt)")),
        (1, say("no outline: scanning 2 of 2 windows in page order…")), (1, say("toc   ", n("a", 50), " (p=", score, ")  ", word, "  in 0.4s (model 0.4s)")), (0, say(word, ": how many…")),
    ]
    form = F.get(F.array(*[F.struct(F.lit(d).alias("depth"), t.alias("text")) for d, t in forms]), pick)
    rows = c.select(F.floor(F.col("conv_id") / 10).alias("run"), "conv_id", "turn", form.alias("f"))
    idx = F.row_number().over(Window.partitionBy("run").orderBy("conv_id", "turn"))
    # one in four lines stands a level deeper
    deeper = (F.col("conv_id") + F.col("turn")) % 4 == 3
    return rows.select("run", idx.alias("idx"), (F.col("f.depth") + deeper.cast("int")).alias("depth"), "f.text", F.endswith("f.text", F.lit("…")).alias("header"))


def log_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logwalk.walks(_log(spark, sf_dir))


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logwalk.files(_log(spark, sf_dir))


def log_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logwalk.reads(_log(spark, sf_dir))


QUERIES = {f.__name__: f for f in (log_walks, log_files, log_reads)}
#: no SQL: tests/test_logwalk.py holds all three against a machine that reads the logs line by line
ORACLE: dict[str, str] = {}
