"""Tables read off documents: runs of rows with the same heads, names, entries, pieces, annotation, composition, pivots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import normalize, singular


def lone(cells: Column) -> Column:
    """A row with exactly one filled cell."""
    return F.size(F.filter(cells, lambda c: c != "")) == 1


def placeholder(cell: Column) -> Column:
    """Whether a cell stands for no value."""
    return normalize(cell).rlike("^(none|n a|na|)$")  # a fixed value


def tables_from(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Runs of data rows with the same ``heads`` are a table; text other than "…" ends it and its group; a lone row names the
    group of the rows after it. ``rows``: ``kind`` (text or row), ``text``, ``heads`` (a string), ``cells``."""
    w = Window.partitionBy(by).orderBy(order)
    is_text = (F.col("kind") == "text") & (F.col("text") != "…")
    is_lone = (F.col("kind") == "row") & lone(F.col("cells"))
    marked = rows.withColumns({"ends": is_text, "lone": is_lone, "data": (F.col("kind") == "row") & ~lone(F.col("cells"))})
    marked = marked.withColumn("stretch", F.sum(F.col("ends").cast("int")).over(w))
    name = F.when(F.col("lone"), F.element_at(F.filter("cells", lambda c: c != ""), 1))
    inside = Window.partitionBy(by, "stretch").orderBy(order)
    marked = marked.withColumn("grp", F.last(name, ignorenulls=True).over(inside))
    data = marked.where("data")
    begins = F.lag("heads").over(inside).isNull() | (F.lag("heads").over(inside) != F.col("heads"))
    return data.withColumn("begins", begins).withColumn("table_id", F.sum(F.col("begins").cast("int")).over(w)).drop("begins", "ends", "lone", "data", "stretch")


def heads_named(cells: Column) -> Column:
    """Heads of a row: empty ones by their place, repeats (and what a head before begins with) with their number, counted against the heads
    before as they are named already, so that no two are the same but those that a head spells itself."""
    filled = F.transform(cells, lambda c, i: F.when(c == "", F.concat(F.lit("column "), (i + 1).cast("string"))).otherwise(c))

    def named(acc: Column, c: Column) -> Column:
        before = F.size(F.filter(acc, lambda x: (x == c) | F.startswith(x, F.concat(c, F.lit(" ")))))
        return F.concat(acc, F.array(F.when(before == 0, c).otherwise(F.concat(c, F.lit(" "), (before + 1).cast("string")))))

    return F.aggregate(filled, F.array().cast("array<string>"), named)


def row_text(heads: Column, cells: Column) -> Column:
    """A lone cell bare; else compact JSON of the filled cells by head, in column order; of no filled cell, nothing. A head that still stands twice
    keeps its first place and its last cell."""
    filled = F.filter(F.arrays_zip(heads.alias("h"), cells.alias("c")), lambda z: z["c"] != "")
    names = F.transform(filled, lambda z: z["h"])
    last = lambda h: F.element_at(F.filter(filled, lambda z: z["h"] == h), -1)["c"]
    written = F.to_json(F.map_from_arrays(F.array_distinct(names), F.transform(F.array_distinct(names), last)))
    return F.when(F.size(filled) == 0, "").when(F.size(filled) == 1, F.element_at(filled, 1)["c"]).otherwise(written)


def same_names(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """For each of ``ours`` (``i``, ``name``) the last of ``theirs`` (``j``, ``name``) with the same normal form, or null."""
    last = theirs.groupBy(normalize(F.col("name")).alias("key")).agg(F.max("j").alias("j"))
    return ours.withColumn("key", normalize(F.col("name"))).join(last, "key", "left").select("i", "name", "j")


def entries(paras: DataFrame, names: DataFrame) -> DataFrame:
    """Paragraphs under the first heading that is a wanted name, up to the next heading; of equal names the last row gets them.

    ``paras``: ``doc``, ``pos``, ``heading``, ``text``; ``names``: ``doc``, ``i``, ``name``."""
    w = Window.partitionBy("doc").orderBy("pos")
    under = paras.withColumn("head_pos", F.last(F.when(F.col("heading"), F.col("pos")), ignorenulls=True).over(w))
    heads = paras.where("heading").select("doc", F.col("pos").alias("head_pos"), normalize(F.col("text")).alias("key"))
    wanted = names.groupBy("doc", normalize(F.col("name")).alias("key")).agg(F.max("i").alias("i"))
    first = heads.join(wanted, ["doc", "key"]).groupBy("doc", "i").agg(F.min("head_pos").alias("head_pos"))
    return under.where("not heading").join(first, ["doc", "head_pos"]).select("doc", "i", "pos", "text")


def pieces(cell: Column) -> Column:
    """Values a cell may hold: the whole, what is before, in and after its first brackets, parts at bullets, commas, semicolons."""
    inner = lambda k: F.trim(F.regexp_extract(cell, r"^([^()]*)\(([^()]*)\)(.*)$", k))
    parts = F.transform(F.split(cell, "[•,;]"), lambda p: F.trim(p))
    return F.array_distinct(F.filter(F.concat(F.array(F.trim(cell), inner(1), inner(2), inner(3)), parts), lambda p: p != ""))


def mostly_filled(cells: DataFrame, by: str, share: float = 0.5, least: int = 2) -> DataFrame:
    """Columns filled in at least max(min(rows, ``least``), rows * ``share``) rows. ``cells``: ``col``, ``cell`` (long)."""
    out = cells.groupBy(by, "col").agg(F.count("*").alias("rows"), F.count_if(F.col("cell") != "").alias("filled"))
    return out.where(F.col("filled") >= F.greatest(F.least(F.col("rows"), F.lit(least)).cast("double"), F.col("rows") * share))


def annotate(items: DataFrame, rows: DataFrame, block: int = 1024) -> DataFrame:
    """For each item the value of the nearest row that has it by name: nearest page, then table, then row; "N/A" without one.

    ``items``: ``item``, ``key``, ``page``; ``rows``: ``key``, ``row_page``, ``table_pos``, ``row_pos``, ``value``. The nearest page is the last
    one with a row at or before the item's, or the first at or after it: within ``block`` pages from one ordered pass, beyond from the blocks'
    first and last rows, so that a key of most rows is many tasks' work."""
    best = rows.groupBy("key", F.col("row_page").alias("page")).agg(F.min(F.struct("table_pos", "row_pos", "value")).alias("best"))
    row = F.struct("page", "best.table_pos", "best.row_pos", "best.value").alias("row")
    known = best.select("key", "page", row, F.lit(False).alias("asks"), F.lit(None).cast(items.schema["item"].dataType).alias("item"))
    marks = known.unionByName(items.select("key", "page", F.lit(None).cast(known.schema["row"].dataType).alias("row"), F.lit(True).alias("asks"), "item"))
    marks = marks.withColumn("block", F.floor(F.col("page") / block))
    ends = marks.groupBy("key", "block").agg(F.min_by("row", F.when(~F.col("asks"), F.col("page"))).alias("first"), F.max_by("row", F.when(~F.col("asks"), F.col("page"))).alias("last"))
    order = Window.partitionBy("key").orderBy("block")
    ends = ends.select("key", "block", F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("far_back"), F.first("first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("far_on"))
    inside = Window.partitionBy("key", "block")
    back = F.last("row", ignorenulls=True).over(inside.orderBy("page", "asks").rowsBetween(Window.unboundedPreceding, 0))
    on = F.last("row", ignorenulls=True).over(inside.orderBy(F.desc("page"), "asks").rowsBetween(Window.unboundedPreceding, 0))
    near = marks.withColumns({"back": back, "on": on}).where("asks").join(ends, ["key", "block"])
    sides = [F.when(x.isNotNull(), F.struct(F.abs(x["page"] - F.col("page")).alias("far"), x["table_pos"].alias("table_pos"), x["row_pos"].alias("row_pos"), x["value"].alias("value"))) for x in (F.coalesce("back", "far_back"), F.coalesce("on", "far_on"))]
    nearest = F.array_min(F.array_compact(F.array(*sides)))
    return near.select("item", "page", F.coalesce(nearest["value"], F.lit("N/A")).alias("value")).distinct()


def composed(cells: DataFrame, *by: str) -> DataFrame:
    """Each (row, column)'s cell from the source that comes first: entry, table, own, derived."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in (("entry", 1), ("table", 2), ("own", 3), ("derived", 4)) for x in kv]), F.col("source"))
    filled = cells.where(~placeholder(F.col("text"))).withColumn("rank", rank)
    best = filled.groupBy(*by).agg(F.min(F.struct("rank", "pos", "text", "source")).alias("b"))
    return cells.select(*by).distinct().join(best, list(by), "left").select(*by, F.coalesce("b.text", F.lit("")).alias("text"), F.coalesce("b.source", F.lit("none")).alias("source"))


def across(cells: DataFrame, columns: list[str]) -> DataFrame:
    """The grid of a cross-document table: a row a document, a column a question, an unanswered cell its reason."""
    shown = F.when(F.col("kind") == "N/A", F.concat(F.lit("N/A: "), F.col("why"))).otherwise(F.col("text"))
    return cells.withColumn("shown", shown).groupBy("row").pivot("col", columns).agg(F.first("shown"))


def named_as(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of a row (``i``, ``name``, ``grp``) and an item (``j``, ``item``) that it names, the one or the other short by its group's noun: an
    equi-join on every spelling a row answers to. The noun is the group's normal form without "mod" or "mods", as it is or its singular."""
    name, noun = normalize(F.col("name")), F.trim(F.regexp_replace(normalize(F.col("grp")), r"\s*\bmods?\b\s*", " "))
    n = rows.select("i", name.alias("n"), F.filter(F.array(noun, singular(noun)), lambda x: x != "").alias("nouns")).where("n <> ''")
    longer = F.transform("nouns", lambda x: F.concat_ws(" ", F.col("n"), x))
    shorter = F.transform(F.filter("nouns", lambda x: F.endswith(F.col("n"), F.concat(F.lit(" "), x))), lambda x: F.expr("n").substr(F.lit(1), F.length("n") - F.length(x) - 1))
    keys = n.select("i", F.explode(F.array_distinct(F.concat(F.array("n"), longer, shorter))).alias("key"))
    return keys.join(items.select("j", normalize(F.col("item")).alias("key")).where("key <> ''"), "key").select("i", "j")


def kept_columns(cells: DataFrame, by: str) -> DataFrame:
    """Columns of a table that a row other than a lone one fills. ``cells``: ``col``, ``cell``, ``lone``."""
    return cells.groupBy(by, "col").agg(F.max((F.col("cell") != "") & ~F.col("lone")).alias("kept")).where("kept").select(by, "col")


def chosen_columns(choices: DataFrame, by: str) -> DataFrame:
    """Columns of each table to keep: the first, which names the row, and every one chosen for a quantity, in order; none where no choice is a
    column. ``choices``: ``col`` (null for "none")."""
    picked = choices.groupBy(by).agg(F.array_sort(F.collect_set("col")).alias("cols"))
    return picked.select(by, F.when(F.size("cols") > 0, F.concat(F.array(F.lit(0)), F.filter("cols", lambda c: c != 0))).alias("keep"))


def match_rows(ours: DataFrame, theirs: DataFrame, answers: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of one table found in another, for many pairs of tables (``tid``) at once: by the normal form of their names first; each that is left chooses among all names of its
    other table that no row has taken, and takes the likeliest from one half on, the first on ties.

    ``ours``: ``tid``, ``i``, ``name``; ``theirs``: ``tid``, ``j``, ``name``; ``answers`` gives ``p`` (hundredths) to asks (``tid``, ``i``, ``j``, ``name``, ``option``). Rows and free names of a
    table meet, as a choice lists all its options; those of different tables never do."""
    key = normalize(F.col("name")).alias("key")
    last = theirs.groupBy("tid", key).agg(F.max("j").alias("j"))
    sure = ours.select("tid", "i", "name", key).join(last, ["tid", "key"], "left")
    taken = sure.where("j is not null").select("tid", "j").distinct()
    free = theirs.join(taken, ["tid", "j"], "left_anti").select("tid", "j", F.col("name").alias("option"))
    asked = answers(sure.where("j is null").select("tid", "i", "name").join(free, "tid")).where("p >= 50")
    best = asked.groupBy("tid", "i").agg(F.max(F.struct("p", (-F.col("j")).alias("back"))).alias("b"))
    return sure.where("j is not null").select("tid", "i", "j", F.lit(100).alias("p")).unionAll(best.select("tid", "i", (-F.col("b.back")).alias("j"), "b.p"))


def entry_pieces(line: Column) -> Column:
    """``label`` (at most 40 characters) and ``value`` of a "Label: value" line, else null."""
    label, value = F.regexp_extract(line, r"^([^:]{1,40}):\s+(\S.*)$", 1), F.regexp_extract(line, r"^([^:]{1,40}):\s+(\S.*)$", 2)
    return F.when(label != "", F.struct(F.trim(label).alias("label"), F.trim(value).alias("value")))


def with_values(items: Column, values: Column) -> Column:
    """A list cell with each item's value behind it, "(N/A)" without one; placeholders stay as they are."""
    shown = F.transform(F.transform(F.split(items, ","), lambda x: F.trim(x)), lambda x: F.when(placeholder(x), x).otherwise(F.concat(x, F.lit(" ("), F.coalesce(F.try_element_at(values, F.lower(x)), F.lit("N/A")), F.lit(")"))))
    return F.array_join(shown, ", ")


def notes_with_rows(units: DataFrame, by: str) -> DataFrame:
    """A lone note row under a data row with the same heads is as likely as that row, if that is more."""
    w = Window.partitionBy(by).orderBy("pos")
    under = F.col("lone") & ~F.lag("lone").over(w) & (F.lag("heads").over(w) == F.col("heads"))
    return units.withColumn("p", F.when(under, F.greatest("p", F.lag("p").over(w))).otherwise(F.col("p")))


def regrouped(units: DataFrame, by: str) -> DataFrame:
    """Chosen units of one paragraph that follow each other as one text; ``gap`` where something was left out before it."""
    w = Window.partitionBy(by).orderBy("pos")
    apart = F.lag("pos").over(w).isNull() | (F.lag("pos").over(w) != F.col("pos") - 1)
    begins = apart | (F.lag("para").over(w) != F.col("para"))
    marked = units.where("chosen").withColumns({"apart": apart, "begins": begins})
    marked = marked.withColumn("run", F.sum(F.col("begins").cast("int")).over(w))
    parts = marked.groupBy(by, "run").agg(F.min("para").alias("para"), F.min_by("apart", "pos").alias("apart"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    return parts.select(by, "run", "para", (F.col("apart") & (F.col("run") > 1)).alias("gap"), "text")
