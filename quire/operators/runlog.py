"""Run logs and spend: log trees, facts, roll-ups, ledgers, history, page-cache policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOLLARS_A_TOKEN = 0.042 / 1_000_000
KEEP_DAYS, KEEP_RUNS = 90, 100


def parents(lines: DataFrame, most_depth: int) -> DataFrame:
    """``parent``: the nearest line before with a smaller ``depth`` (null at the top). ``lines``: ``run``, ``idx``, ``depth``."""
    w = Window.partitionBy("run").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("depth") < d, F.col("idx")), ignorenulls=True).over(w) for d in range(1, most_depth + 1)]
    chosen = F.lit(None).cast("long")
    for d, x in enumerate(last, start=1):
        chosen = F.when(F.col("depth") == d, x).otherwise(chosen)
    return lines.withColumn("parent", chosen.cast("long"))


def rolled_up(lines: DataFrame, most_depth: int) -> DataFrame:
    """Each line's own ``cost`` and all costs under it: sums over the line's stretch, up to the next line as shallow."""
    out = None
    for d in range(most_depth + 1):
        w = Window.partitionBy("run").orderBy("idx")
        block = lines.withColumn("block", F.sum(F.when(F.col("depth") <= d, 1).otherwise(0)).over(w))
        total = block.groupBy("run", "block").agg(F.sum("cost").alias("total"), F.min(F.when(F.col("depth") == d, F.col("idx"))).alias("idx")).where("idx is not null").select("run", "idx", "total")
        out = total if out is None else out.unionAll(total)
    return lines.join(out, ["run", "idx"])


def last_charges(events: DataFrame) -> DataFrame:
    """One charge a run, whatever the number of its reports: the largest; unsent runs are left out."""
    return events.where("sent").groupBy("run", "tool", "day").agg(F.max("dollars").alias("dollars"))


def ledger(events: DataFrame, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Dollars a day and tool, of the last ``keep_days`` days that have any."""
    daily = last_charges(events).groupBy("day", "tool").agg(F.sum("dollars").alias("dollars"))
    days = daily.select("day").distinct().withColumn("k", F.row_number().over(Window.orderBy(F.desc("day")))).where(F.col("k") <= keep_days)
    return daily.join(days.drop("k"), "day")


def spend_window(daily: DataFrame, last_day: Column, days: int, tools: list[str]) -> DataFrame:
    """Dollars over ``days`` days to ``last_day``, in all and by tool."""
    inside = daily.where((F.col("day") <= last_day) & (F.col("day") > F.date_sub(last_day, days)))
    return inside.agg(F.coalesce(F.sum("dollars"), F.lit(0)).alias("dollars"), *[F.coalesce(F.sum(F.when(F.col("tool") == t, F.col("dollars"))), F.lit(0)).alias(t) for t in tools])


def runs(events: DataFrame) -> DataFrame:
    """A run from its events: first and last time, lines, what it ended with."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return events.groupBy("run").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("lines"), last.alias("last"), F.count_if(F.col("event_type") == "error").alias("errors"))


def overflow(files: DataFrame, cap: int) -> DataFrame:
    """What an LRU cache of ``cap`` bytes drops: oldest first until it fits, never the newest. ``files``: ``cache``, ``id``, ``at``, ``bytes``."""
    newer = Window.partitionBy("cache").orderBy(F.desc("at"), F.desc("id"))
    held = F.sum("bytes").over(newer.rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumns({"held": held, "k": F.row_number().over(newer)}).where((F.col("held") > cap) & (F.col("k") > 1)).drop("held", "k")


def recent(questions: DataFrame, typed: str, n: int = 5) -> DataFrame:
    """The newest different questions (ignoring case) that hold what was typed, but for what was typed itself."""
    typed = typed.strip().lower()
    newest = questions.withColumn("q", F.trim("q")).where(F.contains(F.lower("q"), F.lit(typed)) & (F.lower("q") != typed)).groupBy(F.lower("q").alias("key")).agg(F.max(F.struct("at", "id", "q")).alias("b"))
    return newest.select("b.q", "b.at", "b.id").orderBy(F.desc("at"), F.desc("id")).limit(n)


def holding_all(rows: DataFrame, text: str, words: list[str]) -> DataFrame:
    """Rows whose text holds every word."""
    return rows.where(F.forall(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(text), w)))


def palette(rows: DataFrame, label: str, more: str, words: list[str], most: int = 40) -> DataFrame:
    """Matches of a command palette: the first word begins the label, then is inside it, then elsewhere; input order within.
    Without words, the first rows."""
    if not words:
        return rows.withColumn("rank", F.lit(0)).orderBy("ord").limit(most)
    typed = words[0].lower()
    rank = F.when(F.startswith(F.lower(label), F.lit(typed)), 0).when(F.contains(F.lower(label), F.lit(typed)), 1).otherwise(2)
    both = rows.withColumn("__t", F.concat_ws(" ", label, more))
    return holding_all(both, "__t", words).withColumn("rank", rank).orderBy("rank", "ord").limit(most).drop("__t")


def remembered(runs: DataFrame, cap: int) -> DataFrame:
    """History by ``user``: the newest of each id; pinned ones stay, of the others the newest ``cap``. ``place``: pinned first, then newest."""
    newest = runs.groupBy("user", "id").agg(F.max(F.struct("at", "seq", "pinned")).alias("b")).select("user", "id", "b.at", "b.seq", "b.pinned")
    by_time = Window.partitionBy("user").orderBy(F.desc("at"), F.desc("seq"))
    kept = newest.withColumn("n", F.sum(F.when(F.col("pinned"), 0).otherwise(1)).over(by_time)).where(F.col("pinned") | (F.col("n") <= cap))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("pinned"), F.desc("at"), F.desc("seq")))).drop("n", "seq")


def within_cases(trace: DataFrame, cases: DataFrame) -> DataFrame:
    """Each trace row's case: the last that began at or before it (``user``, ``ts``), from one ordered pass over both."""
    both = cases.select("user", "ts", F.lit(0).alias("kind"), F.col("id").alias("case"), F.lit(None).cast("long").alias("id")).unionAll(trace.select("user", "ts", F.lit(1), F.lit(None).cast("long"), "id"))
    w = Window.partitionBy("user").orderBy("ts", "kind", "case", "id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("case", F.last("case", ignorenulls=True).over(w)).where("kind = 1").select("user", "id", "case")


def split_spend(rows: DataFrame) -> DataFrame:
    """Millionths of a dollar of the tokens, and the wall time that no kind accounts for (never below 0)."""
    return rows.withColumns({"micros": F.floor(F.col("tokens") * 42 / 1000).cast("long"), "other": F.greatest(F.lit(0), F.col("wall") - F.col("api") - F.col("extract"))})


def placed(pages: DataFrame, gap: int, block: int = 4096) -> DataFrame:
    """Top of each page in a viewer: heights and gaps before it. Sums of blocks of pages, then sums within a block, so that a book
    of most pages is many tasks' work."""
    cut = pages.withColumn("__block", F.floor((F.col("page") - 1) / F.lit(block)))
    ahead = Window.partitionBy("book").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("book", "__block").agg(F.sum(F.col("height") + gap).alias("__sum"))
    sums = sums.withColumn("__ahead", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum")
    before = Window.partitionBy("book", "__block").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("__own", F.coalesce(F.sum(F.col("height") + gap).over(before), F.lit(0)))
    return own.join(sums, ["book", "__block"]).withColumn("top", F.col("__ahead") + F.col("__own")).drop("__block", "__own", "__ahead")


def page_at(tops: DataFrame, probes: DataFrame, block: int = 4096) -> DataFrame:
    """The page of each probe (``book``, ``y``, and what identifies it) in a laid out book: the last that starts at or above ``y``, the first above all, 1 in a book of no pages.

    A page reaches to the next one's top; it and a probe meet by stretches of ``block``, so no book is searched by one task. ``tops``: ``book``, ``page``, ``top``."""
    ends = F.coalesce(F.lead("top").over(Window.partitionBy("book").orderBy("page")) - 1, F.col("top"))
    spans = tops.withColumn("__end", ends)
    last = tops.groupBy("book").agg(F.max("top").alias("__last"), F.min("top").alias("__first"))
    keyed = spans.withColumn("__key", F.explode(F.sequence(F.floor(F.col("top") / block), F.floor(F.col("__end") / block)))).select(F.col("book").alias("__book"), "page", "top", "__end", "__key")
    held = probes.join(last, "book", "left").withColumn("__y", F.least(F.greatest("y", "__first"), "__last")).withColumn("__at", F.floor(F.col("__y") / block))
    on = (F.col("book") == F.col("__book")) & (F.col("__at") == F.col("__key")) & F.col("__y").between(F.col("top"), F.col("__end"))
    met = held.join(keyed, on, "left").withColumn("page", F.coalesce("page", F.lit(1)))
    return met.select(*probes.columns, "page")


def percent_box(box: Column, width: Column, height: Column) -> Column:
    """A box (``x0``, ``y0``, ``x1``, ``y1``) as percentages of its page, to lay over the page at any size."""
    share = lambda v, of: 100 * v / of
    return F.struct(share(box["x0"], width).alias("left"), share(box["y0"], height).alias("top"), share(box["x1"] - box["x0"], width).alias("width"), share(box["y1"] - box["y0"], height).alias("height"))


LINE = r"^(\s*)(.*?)(?:\s+\[(\d+) in, (\d+) out\])?$"


def parsed(line: Column) -> Column:
    """``depth`` (two spaces each), ``text``, ``in`` and ``out`` tokens (0 without a cost) and ``header`` (ends in "…") of a log line."""
    part = lambda k: F.regexp_extract(line, LINE, k)
    return F.struct(F.floor(F.length(part(1)) / 2).cast("int").alias("depth"), part(2).alias("text"), F.coalesce(F.nullif(part(3), F.lit("")).cast("long"), F.lit(0)).alias("tokens_in"), F.coalesce(F.nullif(part(4), F.lit("")).cast("long"), F.lit(0)).alias("tokens_out"), F.endswith(part(2), F.lit("…")).alias("header"))


def in_flight(lines: DataFrame) -> DataFrame:
    """What the call that a stopped run left open may have cost: the rounded mean of the calls that it reported (leaf lines with a cost), null
    without one. ``lines``: ``run``, ``idx``, ``depth``, ``cost`` (null without) and ``stopped``; a line is a leaf if the next is no deeper."""
    leaf = F.coalesce(F.lead("depth").over(Window.partitionBy("run").orderBy("idx")) <= F.col("depth"), F.lit(True))
    calls = lines.where("stopped").withColumn("leaf", leaf)
    mean = F.try_divide(F.sum(F.when(F.col("leaf"), F.col("cost"))), F.count_if(F.col("leaf") & F.col("cost").isNotNull()))
    return calls.groupBy("run").agg(F.floor(mean + 0.5).alias("cost"))


def stepped(runs: DataFrame) -> DataFrame:
    """For each run of a user's history (``user``, ``id``, ``at``, ``place``) the ``older`` and ``newer`` one in time, and its ``successor`` in the list
    once it is gone: the one after it, else the one before."""
    by_time, listed = Window.partitionBy("user").orderBy(F.desc("at"), "place"), Window.partitionBy("user").orderBy("place")
    return runs.withColumns({"older": F.lead("id").over(by_time), "newer": F.lag("id").over(by_time), "successor": F.coalesce(F.lead("id").over(listed), F.lag("id").over(listed))})
