"""Greedy packing of a section's pages, runs of probabilities, unit chunks: sequential steps as folds over bounded arrays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space as the windows' trim takes it.
BLANKS = " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def section_pages(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Each section's pages in order as one array (a section is bounded, a book is not): their characters, and how many of those are white space
    before (``lead``; of a blank page, all) and after (``trail``) the rest."""
    spans = sections.select("book", "path", F.explode(F.sequence("start", "end")).alias("page"))
    sized = pages.select("book", "page", F.length("text").alias("chars"), (F.length("text") - F.length(F.ltrim("text", F.lit(BLANKS)))).alias("lead"), (F.length("text") - F.length(F.rtrim("text", F.lit(BLANKS)))).alias("trail"))
    return spans.join(sized, ["book", "page"]).groupBy("book", "path").agg(F.array_sort(F.collect_list(F.struct("page", "chars", "lead", "trail"))).alias("items"))


def page_windows(items: Column, chars: int, least: int = 200) -> Column:
    """Windows of whole pages: a page that would take a non-empty window over ``chars`` starts the next one, so that blank
    pages join whatever follows; windows with at most ``least`` characters between the white space at their ends are left out."""
    zero = F.lit(0)
    start = F.struct(F.array().cast("array<struct<page:int,end:int,chars:int,solid:int>>").alias("done"), zero.alias("first"), zero.alias("last"), zero.alias("chars"), zero.alias("lead"), zero.alias("trail"))

    def closed(acc: Column) -> Column:
        solid = F.greatest(acc["chars"] - acc["lead"] - acc["trail"], zero)
        return F.concat(acc["done"], F.array(F.struct(acc["first"].alias("page"), acc["last"].alias("end"), acc["chars"].alias("chars"), solid.alias("solid"))))

    def step(acc: Column, item: Column) -> Column:
        full = (acc["chars"] > 0) & (acc["chars"] + item["chars"] > chars)
        fresh = full | (acc["first"] == 0)
        before = F.when(full, zero).otherwise(acc["chars"])
        blank_so_far = F.when(full, F.lit(True)).otherwise(acc["lead"] == acc["chars"])
        return F.struct(
            F.when(full, closed(acc)).otherwise(acc["done"]).alias("done"),
            F.when(fresh, item["page"]).otherwise(acc["first"]).alias("first"),
            item["page"].alias("last"),
            (before + item["chars"]).alias("chars"),
            F.when(blank_so_far, before + item["lead"]).otherwise(acc["lead"]).alias("lead"),
            F.when(item["lead"] < item["chars"], item["trail"]).otherwise(F.when(full, zero).otherwise(acc["trail"]) + item["chars"]).alias("trail"),
        )

    return F.filter(F.aggregate(items, start, step, closed), lambda w: w["solid"] > least)


def pieces(text: Column, chars: int) -> Column:
    """A text in pieces of at most ``chars`` characters that join to it: cut after sentences and blank lines, with the white space behind them; a sentence
    longer than that is cut inside, before its last space that still fits. Sentences are packed in one fold over their lengths, which carries where
    the open piece begins; \u0001 must not occur in the text."""
    ends = F.regexp_replace(text, r"""((?:[.!?]+["')\]]*(?=\s|\z)|\n[ \t]*\n)\s*)""", "$1\u0001")
    runs = F.filter(F.split(ends, "\u0001"), lambda r: r != "")
    inside = f"(?s)(.{{1,{chars}}}\\z|.{{1,{chars}}}(?= )|.{{1,{chars}}})"
    one = lambda r, fresh: F.struct(r.alias("text"), F.length(r).alias("size"), fresh.alias("fresh"))
    long = lambda r: F.transform(F.regexp_extract_all(r, F.lit(inside), F.lit(1)), lambda p, i: one(p, i == 0))
    items = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > chars, long(r)).otherwise(F.array(one(r, F.lit(False))))))
    zero = F.lit(0)
    start = F.struct(F.array().cast("array<struct<at:int,n:int>>").alias("done"), zero.alias("at"), zero.alias("i"), zero.alias("size"))
    closed = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["at"].alias("at"), (acc["i"] - acc["at"]).alias("n"))))

    def step(acc: Column, item: Column) -> Column:
        over = (acc["size"] > 0) & ((acc["size"] + item["size"] > chars) | item["fresh"])
        return F.struct(F.when(over, closed(acc)).otherwise(acc["done"]).alias("done"), F.when(over, acc["i"]).otherwise(acc["at"]).alias("at"), (acc["i"] + 1).alias("i"), F.when(over, item["size"]).otherwise(acc["size"] + item["size"]).alias("size"))

    cut = F.transform(F.array(items), lambda it: F.struct(it.alias("items"), F.aggregate(it, start, step, lambda acc: F.when(acc["size"] > 0, closed(acc)).otherwise(acc["done"])).alias("cuts")))
    joined = F.flatten(F.transform(cut, lambda c: F.transform(c["cuts"], lambda x: F.array_join(F.transform(F.slice(c["items"], x["at"] + 1, x["n"]), lambda i: i["text"]), ""))))
    return F.when(F.length(text) <= chars, F.array(text)).otherwise(joined)


def batches(sizes: Column, most: int) -> Column:
    """The batch number (from 1) of each size: a size that would take the batch over ``most`` starts the next."""
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("id"), F.lit(None).cast("int").alias("size"))

    def step(acc: Column, n: Column) -> Column:
        over = acc["size"].isNull() | (acc["size"] + n > most)
        nth = F.when(over, acc["id"] + 1).otherwise(acc["id"])
        return F.struct(F.concat(acc["ids"], F.array(nth)).alias("ids"), nth.alias("id"), F.when(over, n).otherwise(acc["size"] + n).alias("size"))

    return F.aggregate(sizes, start, step, lambda acc: acc["ids"])


def best_run(units: DataFrame, by: str, order: str, share: str, bar: int = 65) -> DataFrame:
    """The run of units with the largest sum of ``share`` (whole hundredths) above ``bar``: prefix sums and their running
    minimum; of equal runs the earliest end, from the latest start that gives it. Groups without a positive run have none."""
    w = Window.partitionBy(by).orderBy(order)
    run = units.withColumn("__sum", F.sum(F.col(share) - bar).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    run = run.withColumn("__least", F.least(F.lit(0), F.min("__sum").over(ahead)))
    before = F.struct((F.col("__sum") * -1).alias("s"), F.col(order).alias("at"))
    run = run.withColumn("__low", F.max(before).over(ahead))
    start = F.when(F.col("__low").isNull() | (F.col("__low.s") < 0), F.lit(-1)).otherwise(F.col("__low.at"))
    run = run.withColumns({"__gain": F.col("__sum") - F.coalesce("__least", F.lit(0)), "__from": start})
    best = run.where("__gain > 0").groupBy(by).agg(F.max(F.struct(F.col("__gain").alias("gain"), (-F.col(order)).alias("end"), F.col("__from").alias("after"))).alias("b"))
    return best.select(by, (F.col("b.after") + 1).alias("start"), (1 - F.col("b.end")).alias("end"), F.col("b.gain").cast("long").alias("gain"))


def islands(rows: DataFrame, by: str, order: str, breaks: Column) -> DataFrame:
    """``island``: how many rows of the group so far begin one."""
    return rows.withColumn("island", F.sum(F.when(breaks, 1).otherwise(0)).over(Window.partitionBy(by).orderBy(order)))


def names_by(words: DataFrame, by: str, of: bool = False) -> DataFrame:
    """Names in running words: one begins with a word that can ``start`` one and goes on over words that can ``go`` on, never over a ``stop`` word; a word that
    ``ends`` closes it. With ``of``, an "of" between two words of a name stays inside.

    A word is linked to the one before it where a name that has reached that one would take it; a stretch of linked words is a name from its first
    starting word on. ``words``: the group, ``pos``, ``word``, ``ends``, ``start``, ``go``, ``stop``. Returns ``pos``, ``end`` and the ``name``'s words."""
    w = Window.partitionBy(by).orderBy("pos")
    flag = lambda c: F.coalesce(c, F.lit(False))
    ok = F.col("go") & ~F.col("stop")
    rows = words.withColumns({"ok": ok, "begin": F.col("start") & ~F.col("stop")})
    closed = F.coalesce(F.lag("ends").over(w), F.lit(True))
    linked = F.col("ok") & ~closed
    if of:
        joins = F.lower("word") == "of"
        middle = joins & ~F.col("ok") & ~closed & flag(F.lead("ok").over(w))
        rows = rows.withColumn("middle", middle)
        linked = linked | F.col("middle") | (F.col("ok") & flag(F.lag("middle").over(w)))
    rows = rows.withColumn("stretch", F.sum(F.when(linked, 0).otherwise(1)).over(w))
    inside = Window.partitionBy(by, "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("begun", F.max(F.col("begin").cast("int")).over(inside)).where("begun = 1")
    return rows.groupBy(by, "stretch").agg(F.min("pos").alias("pos"), F.max("pos").alias("end"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "word", "stop"))), lambda x: x["word"]).alias("name")).drop("stretch")


def trimmed(names: DataFrame, joining: list[str]) -> DataFrame:
    """``names`` without the ``joining`` words at their ends; of nothing but such words, none is left."""
    counted = F.transform("name", lambda x, i: F.when(~F.lower(x).isin(*joining), i))
    held = names.withColumns({"__a": F.array_min(counted), "__b": F.array_max(counted)}).where("__a is not null")
    return held.withColumns({"name": F.slice("name", F.col("__a") + 1, F.col("__b") - F.col("__a") + 1), "pos": F.col("pos") + F.col("__a"), "end": F.col("pos") + F.col("__b")}).drop("__a", "__b")


def best_runs(units: DataFrame, by: str, bar: int = 65, least: int = 25) -> DataFrame:
    """All runs worth showing of each group: the best one, then the best of what is left, as long as it gains ``least``.

    ``units``: the group, ``pos``, ``share`` (whole hundredths). A group is a document's units; it is worked on in one task."""
    kind = units.schema[by].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        value, out = (frame["share"] - bar).tolist(), []
        while True:
            best, start, total = (0, -1, -1), 0, 0
            for i, x in enumerate(value):
                if total <= 0:
                    start, total = i, 0
                total += x
                if total > best[0]:
                    best = (total, start, i + 1)
            if best[0] <= 0 or (out and best[0] < least):
                break
            out.append(best)
            value[best[1] : best[2]] = [-100] * (best[2] - best[1])
        return pd.DataFrame([(frame[by].iloc[0], a, b, g) for g, a, b in sorted(out, key=lambda x: x[1])], columns=[by, "start", "end", "gain"])

    return units.select(by, "pos", "share").groupBy(by).applyInPandas(run, f"`{by}` {kind}, start int, end int, gain long")
