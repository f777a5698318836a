"""What a run's log says it read: files, reads and verdicts, off the lines as they stand.

The reader of a log is a machine with a few registers: the file it is in, the last read, the depth of an open scan, the depth at which paths were ranked, the open
headers. Each register holds the last line of some kind, so each is a running window over the run's lines: lines are classed by patterns, cut into files by
a running count, and a verdict finds its read as the last one of its name before it. No run is collected.

``lines``: ``run``, ``idx``, ``depth``, ``text``, ``header`` (as ``runlog.parsed`` gives them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How the lines of a log are written.
PATHS = r"^ranked (\d+) paths"
ABOVE = r"(\d+) above file floor ([\d.]+)"
FILE = r"^(\d\.\d\d)\s{2}(.+?)(?:\s{2}\(by p\.\d+\))?…$"
LEFT = r"^(\d\.\d\d|--)\s{2}(.+?)(?:\s{2}\(by p\.\d+\))?\s{2}--\s{2}(.+)$"
SECTIONS = r"^ranked (\d+) sections and (\d+) excerpts"
CACHED = r"^ranked from cache"
SECTION = r"^section (.+?)\s{2}p\.(\d+)-(\d+)…$"
EXCERPT = r"^excerpt\s+(yes|no)\s+(\d\.\d\d)\s+(.+?)(?: \(excerpt\))?…?$"
SCAN = r"^no outline: scanning"
GATE = r"^(yes|no)\s+(\d\.\d\d)\s+(?:[\d.]+s \w+\s+)?(.+)$"
VERDICT = r"^(take|keep|drop)\s+(.+) \(p=(\d\.\d\d)\)\s{2}(.+)$"
CONTENTS = r"^toc\s+(.+?) \(p=(\d\.\d\d)\)\s{2}(.+?)\s{2}in "


def _part(pattern: str, n: int, as_type: str = "string") -> Column:
    return F.regexp_extract("text", pattern, n).cast(as_type)


RUN = ["run"]
STRENGTH = {"drop": 0, "keep": 1, "take": 2}


def classed(lines: DataFrame, most_depth: int = 8) -> DataFrame:
    """Lines with their ``kind``, the ``file`` they stand in (a number) and the header they stand ``under``, if one is open a level up."""
    ahead = Window.partitionBy(*RUN).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*RUN).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda pattern: F.col("text").rlike(pattern)
    # a line's parent is the nearest before it that is less deep; it closed whatever was open below it
    parents = [F.last(F.when(F.col("depth") < d, F.struct("depth", "header", "text")), ignorenulls=True).over(ahead) for d in range(1, most_depth + 1)]
    parent = F.get(F.array(*parents), F.col("depth") - 1)
    ranked = lines.withColumns({"at": F.last(F.when(is_(PATHS), F.col("depth")), ignorenulls=True).over(so_far), "parent": F.when(F.col("depth") > 0, parent)})
    kind = F.when(is_(PATHS), "paths").when(is_(r"^ranked (\d+) names"), "names")
    kind = kind.when(F.col("header") & (F.col("depth") == F.col("at")) & is_(FILE), "file")
    kind = kind.when(~F.col("header") & (F.col("depth") == F.coalesce("at", "depth")) & is_(LEFT), "left")
    for name, pattern in (("sections", SECTIONS), ("cached", CACHED), ("section", SECTION), ("excerpt", EXCERPT), ("scan", SCAN), ("gate", GATE), ("verdict", VERDICT), ("contents", CONTENTS)):
        kind = kind.when(is_(pattern), name)
    opened = (F.col("parent.depth") == F.col("depth") - 1) & F.col("parent.header")
    under = F.when(opened, F.substring("parent.text", F.lit(1), F.length("parent.text") - 1))
    cut = F.sum(F.when(F.col("kind").isin("paths", "file", "left"), 1).otherwise(0)).over(so_far)
    return ranked.withColumn("kind", kind).select("run", "idx", "depth", "text", "kind", under.alias("under"), cut.cast("int").alias("file"))


def _marked(lines: DataFrame) -> DataFrame:
    """Classed lines that say something of a read, with ``read`` (the line of the last read of the file so far) and ``name``.

    A gate's line is of the section being read, unless a scan is under way or the last read is no section: then it is a read itself, a window.
    """
    of_file = Window.partitionBy("run", "file").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    by_idx = Window.partitionBy(*RUN).orderBy("idx")
    scan = F.sum(F.when(F.col("kind") == "scan", 1).otherwise(0)).over(by_idx.rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("scan", scan)
    in_scan = Window.partitionBy("run", "scan").orderBy("idx")
    # a scan is open until a line as shallow as its own
    rows = rows.withColumns({"scanned": F.first(F.when(F.col("kind") == "scan", F.col("depth"))).over(in_scan), "least": F.min(F.when(F.col("kind").isNull() | (F.col("kind") != "scan"), F.col("depth"))).over(in_scan.rowsBetween(Window.unboundedPreceding, 0))})
    scanning = F.col("scanned").isNotNull() & (F.coalesce("least", F.col("scanned") + 1) > F.col("scanned"))
    rows = rows.withColumn("scanning", scanning)
    begun = F.when(F.col("kind").isin("section", "excerpt", "contents"), F.col("kind")).when((F.col("kind") == "gate") & F.col("scanning"), "window")
    rows = rows.withColumn("last", F.last(begun, ignorenulls=True).over(of_file))
    begun = F.coalesce(begun, F.when((F.col("kind") == "gate") & (F.coalesce("last", F.lit("")) != "section"), "window"))
    pages = F.when(_part(SECTION, 2) == _part(SECTION, 3), _part(SECTION, 2)).otherwise(F.concat_ws("-", _part(SECTION, 2), _part(SECTION, 3)))
    name = (
        F.when(F.col("kind") == "section", F.concat(_part(SECTION, 1), F.lit(" p."), pages))
        # without contents, an excerpt is called by its page twice
        .when(F.col("kind") == "excerpt", F.regexp_replace(_part(EXCERPT, 3), r"^(p\.\d+) \1$", "$1"))
        .when(F.col("kind") == "contents", _part(CONTENTS, 3))
        .when(F.col("kind") == "gate", _part(GATE, 3))
        .when(F.col("kind") == "verdict", F.regexp_replace(_part(VERDICT, 4), r" \(excerpt\)$", ""))
    )
    rows = rows.withColumns({"begun": begun, "name": name}).where("name is not null")
    # a verdict in a file where nothing was read before it is a window; those after it are of the same
    rows = rows.withColumn("first", F.first("idx").over(of_file))
    alone = (F.col("kind") == "verdict") & (F.col("idx") == F.col("first"))
    rows = rows.withColumns({"begun": F.coalesce("begun", F.when(alone, "window")), "name": F.when(alone, _part(VERDICT, 4)).otherwise(F.col("name"))})
    began = F.when(F.col("begun").isNotNull(), F.col("idx"))
    by_name = Window.partitionBy("run", "file", "name").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    named, current = F.last(began, ignorenulls=True).over(by_name), F.last(began, ignorenulls=True).over(of_file)
    return rows.withColumn("read", F.when(F.col("kind") == "verdict", F.coalesce(named, current)).otherwise(current))


def reads(lines: DataFrame) -> DataFrame:
    """Every read of every run: ``file`` and ``read`` (line numbers of a run, in order), ``kind``, ``name``, the gate's best ``p`` and ``gate``, and of the strongest
    verdict (the last of equals) ``verdict``, ``answer``, ``sure`` and ``page``."""
    marked = _marked(classed(lines))
    gate = F.when(F.col("kind") == "excerpt", _part(EXCERPT, 1)).when(F.col("kind") == "gate", _part(GATE, 1))
    p = F.when(F.col("kind") == "excerpt", _part(EXCERPT, 2, "double")).when(F.col("kind") == "gate", _part(GATE, 2, "double")).when(F.col("kind") == "contents", _part(CONTENTS, 2, "double"))
    verdict = F.when(F.col("kind") == "verdict", _part(VERDICT, 1)).when(F.col("kind") == "contents", "take")
    answer = F.when(F.col("kind") == "verdict", _part(VERDICT, 2)).when(F.col("kind") == "contents", _part(CONTENTS, 1))
    sure = F.when(F.col("kind") == "verdict", _part(VERDICT, 3, "double")).when(F.col("kind") == "contents", _part(CONTENTS, 2, "double"))
    page = F.when(F.col("kind") == "verdict", F.element_at(F.regexp_extract_all(_part(VERDICT, 4), F.lit(r"p\.(\d+)"), F.lit(1)), -1).cast("int"))
    strength = F.element_at(F.create_map(*[F.lit(x) for pair in STRENGTH.items() for x in pair]), F.col("verdict"))
    said = marked.select("run", "file", "read", "idx", "begun", "name", gate.alias("gate"), p.alias("p"), verdict.alias("verdict"), answer.alias("answer"), sure.alias("sure"), page.alias("page")).withColumn("strength", strength)
    before = Window.partitionBy("run", "file", "read").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    counts = F.col("strength") >= F.coalesce(F.max("strength").over(before), F.lit(0))
    said = said.withColumn("counts", F.coalesce(counts, F.lit(False)))
    best = F.max(F.when(F.col("counts"), F.struct("idx", "verdict", "answer", "sure")))
    return said.groupBy("run", "file", "read").agg(
        F.max(F.when(F.col("idx") == F.col("read"), F.struct("begun", "name"))).alias("r"),
        F.max("p").alias("p"), F.max("gate").alias("gate"), best.alias("v"),
        F.max(F.when(F.col("counts") & F.col("page").isNotNull(), F.struct("idx", "page"))).alias("g"),
    ).select("run", "file", "read", F.col("r.begun").alias("kind"), "r.name", "p", "gate", "v.verdict", "v.answer", "v.sure", "g.page")


def files(lines: DataFrame) -> DataFrame:
    """Every file of every run that was opened (``path`` null for the file of a run without a shelf), or left out and why (``left``), with how its sections were ``ranked``."""
    of_file = classed(lines).where("kind is not null and kind not in ('scan', 'names')")
    sections, excerpts = _part(SECTIONS, 1), _part(SECTIONS, 2)
    ranked = F.when(F.col("kind") == "cached", "from the cache").when(F.col("kind") == "sections", F.concat(sections, F.when(sections == "1", " section").otherwise(" sections"), F.when(excerpts == "0", "").otherwise(F.concat(F.lit(" and "), excerpts, F.when(excerpts == "1", " excerpt").otherwise(" excerpts")))))
    opened = of_file.where("kind not in ('paths', 'left')").groupBy("run", "file").agg(
        F.max(F.when(F.col("kind") == "file", F.struct(_part(FILE, 2).alias("path"), _part(FILE, 1, "double").alias("score"), F.col("under").alias("under")))).alias("f"),
        F.max_by(ranked, F.when(ranked.isNotNull(), F.col("idx"))).alias("ranked"), F.min("idx").alias("at"),
    )
    out = opened.select("run", "at", "file", "f.path", "f.score", "ranked", "f.under", F.lit(None).cast("string").alias("left"))
    left = of_file.where("kind = 'left'").select("run", F.col("idx").alias("at"), "file", _part(LEFT, 2).alias("path"), F.when(_part(LEFT, 1) != "--", _part(LEFT, 1).try_cast("double")).alias("score"), F.lit(None).cast("string").alias("ranked"), "under", _part(LEFT, 3).alias("left"))
    return out.unionByName(left)


def walks(lines: DataFrame) -> DataFrame:
    """A run in a row: the latest ranking of its paths and how many there were, files opened and left out, reads by kind and what was taken."""
    rows = classed(lines)
    latest = F.max(F.when(F.col("kind") == "paths", F.struct("idx", _part(PATHS, 1, "int").alias("ranked"), F.nullif(_part(ABOVE, 1), F.lit("")).try_cast("int").alias("above"), F.nullif(_part(ABOVE, 2), F.lit("")).alias("floor")))).alias("p")
    names = F.max_by(F.when(F.col("kind") == "names", F.regexp_extract("text", r"^ranked (\d+) names", 1).cast("int")), F.when(F.col("kind") == "names", F.col("idx"))).alias("names")
    ranked = rows.groupBy("run").agg(latest, F.count_if(F.col("kind") == "paths").alias("times"), names)
    opened = files(lines).groupBy("run").agg(F.count_if(F.col("left").isNull()).alias("opened"), F.count("left").alias("left_out"))
    read = reads(lines).groupBy("run").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_reads") for k in ("contents", "section", "excerpt", "window")], F.count_if(F.col("verdict") == "take").alias("took"))
    out = ranked.join(opened, "run", "left").join(read, "run", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("opened", "left_out", "contents_reads", "section_reads", "excerpt_reads", "window_reads", "took")]
    return out.select("run", "p.ranked", "p.above", "p.floor", "times", "names", *counts)
