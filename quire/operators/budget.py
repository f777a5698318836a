"""A walk over files under one budget: each file gets what the files before it left of the takes and of the keeps.

What a file reads does not depend on the budget, only where it stops. So every (question, file) is walked by itself, in parallel, and reduced to a
summary whose size the budget bounds: the first step at which each number of takes, and each number of keeps, is reached. A question's
summaries, in the files' order, are folded with the rest of both budgets in the state; each file's last step is joined back to its steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.outline import ancestors
from quire.operators.walk import order

ONE = ["qid", "file"]


def _ahead(what: str) -> Column:
    """Rows of that verdict up to and with this step."""
    upto = Window.partitionBy(*ONE).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.when(F.col("verdict") == what, 1).otherwise(0)).over(upto)


def steps(rows: DataFrame, title_floor: float | None = None) -> DataFrame:
    """The steps of each question in each file, as if nothing stopped it: ``takes`` and ``keeps`` after each, and the step at which a kept row is
    ``moved`` to the dropped ones.

    ``rows``: ``qid``, ``file``, ``section`` (a path), ``section_score``, ``page``, ``gate``, ``p``, ``verdict`` and ``whole`` (the section is counted in one
    step, by its best window). Once a section has been counted, what lies under it is not read, and what was kept of it before is a fragment of
    the count: it goes to the dropped rows. A section below ``title_floor`` is read only while the file has given nothing.
    """
    by_section = Window.partitionBy(*ONE, "section").orderBy(F.desc("gate"), "page")
    once = rows.withColumn("__k", F.row_number().over(by_section)).where(~F.col("whole") | (F.col("__k") == 1)).drop("__k")
    numbered = once.withColumn("step", F.row_number().over(Window.partitionBy(*ONE).orderBy(*order())))
    counted = numbered.where("whole").select(*ONE, F.col("section").alias("above"), F.col("step").alias("at"))
    met = numbered.select(*ONE, "step", F.explode(ancestors(F.col("section"))).alias("above")).join(counted, [*ONE, "above"])
    around = met.groupBy(*ONE, "step").agg(F.min("at").alias("first"), F.min(F.when(F.col("at") > F.col("step"), F.col("at"))).alias("moved"))
    read = numbered.join(around, [*ONE, "step"], "left").where(F.col("first").isNull() | (F.col("first") > F.col("step")))
    if title_floor is not None:
        before = F.coalesce(_ahead("take") - F.when(F.col("verdict") == "take", 1).otherwise(0), F.lit(0))
        read = read.withColumn("__t", before).withColumn("__t", F.min("__t").over(Window.partitionBy(*ONE, "section")))
        read = read.where((F.col("section_score") >= title_floor) | (F.col("__t") == 0)).drop("__t")
    read = read.withColumn("moved", F.when(F.col("verdict") == "keep", F.col("moved")))
    back = read.where("moved is not null").groupBy(*ONE, F.col("moved").alias("step")).agg(F.count("*").alias("back"))
    read = read.join(back, [*ONE, "step"], "left")
    upto = Window.partitionBy(*ONE).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.sum(F.coalesce("back", F.lit(0))).over(upto)
    return read.select(*ONE, "step", "section", "page", "p", "verdict", "moved", _ahead("take").alias("takes"), (_ahead("keep") - gone).alias("keeps"))


def summaries(walked: DataFrame, hits: int, most_kept: int) -> DataFrame:
    """For each question and file the first step that reaches 1, 2, ... takes and keeps, and the last step, each with both counts."""
    at = F.struct("step", "takes", "keeps")
    reached = lambda what, count, n: F.min(F.when((F.col("verdict") == what) & (F.col(count) == n), at))
    return walked.groupBy(*ONE).agg(
        F.array(*[reached("take", "takes", n) for n in range(1, hits + 1)]).alias("by_takes"),
        F.array(*[reached("keep", "keeps", n) for n in range(1, most_kept + 1)]).alias("by_keeps"),
        F.max(at).alias("end"),
    )


def allotted(files: DataFrame, summed: DataFrame, hits: int, most_kept: int, floor: float | None = None, hard: bool = False) -> DataFrame:
    """``files`` (``qid``, ``file``, ``rank``, ``score``) that are opened, with the budget each gets (``hits_left``, ``keeps_left``) and its last step (``stop``).

    A file below ``floor`` is opened only while nothing has been taken (``hard``: never). A question's files must be a ranking's first few.
    """
    nothing = F.struct(F.lit(0).alias("step"), F.lit(0).cast("long").alias("takes"), F.lit(0).cast("long").alias("keeps"))
    each = files.join(summed, ONE, "left").select("qid", F.struct("rank", "file", "score", "by_takes", "by_keeps", F.coalesce("end", nothing).alias("end")).alias("f"))
    lists = each.groupBy("qid").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    opened = "array<struct<file:string,rank:int,hits_left:long,keeps_left:long,stop:int>>"
    start = F.struct(F.lit(0).cast("long").alias("takes"), F.lit(0).cast("long").alias("keeps"), F.lit(False).alias("over"), F.array().cast(opened).alias("opened"))

    def step(acc: Column, f: Column) -> Column:
        shut = F.lit(False) if floor is None else (f["score"] < floor) & (F.lit(True) if hard else acc["takes"] > 0)
        over = acc["over"] | shut
        h, k = hits - acc["takes"], most_kept - acc["keeps"]
        ends = F.coalesce(F.least(F.get(f["by_takes"], (h - 1).cast("int")), F.get(f["by_keeps"], (k - 1).cast("int"))), f["end"])
        row = F.struct(f["file"].alias("file"), f["rank"].cast("int").alias("rank"), h.alias("hits_left"), k.alias("keeps_left"), ends["step"].alias("stop"))
        takes, keeps = acc["takes"] + ends["takes"], acc["keeps"] + ends["keeps"]
        read = F.struct(takes.alias("takes"), keeps.alias("keeps"), ((takes >= hits) | (keeps >= most_kept)).alias("over"), F.concat(acc["opened"], F.array(row)).alias("opened"))
        stay = F.struct(acc["takes"].alias("takes"), acc["keeps"].alias("keeps"), F.lit(True).alias("over"), acc["opened"].alias("opened"))
        return F.when(over, stay).otherwise(read)

    folded = lists.select("qid", F.aggregate("fs", start, step, lambda acc: acc["opened"]).alias("o"))
    return folded.select("qid", F.inline("o"))


def shelf_walk(files: DataFrame, rows: DataFrame, hits: int = 1, most_kept: int = 5, floor: float | None = None, hard: bool = False, title_floor: float | None = None) -> DataFrame:
    """What a walk over each question's ``files`` reads: ``outcome`` is take, keep or drop, a kept fragment of a section that the walk counted later being dropped."""
    walked = steps(rows, title_floor)
    ends = allotted(files, summaries(walked, hits, most_kept), hits, most_kept, floor, hard)
    read = walked.join(ends, ONE).where(F.col("step") <= F.col("stop"))
    fragment = F.coalesce(F.col("moved") <= F.col("stop"), F.lit(False))
    return read.select("qid", "rank", "file", "step", "section", "page", "p", F.when(fragment, "drop").otherwise(F.col("verdict")).alias("outcome"), fragment.alias("fragment"))
