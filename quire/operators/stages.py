"""A table to order, filled in stages: each asks only about the cells that all stages before it left open.

Columns are settled one by one (where is it read from?), cells follow. What is asked for is a table of open columns or open cells, made by an anti-join with all that is there, and every
stage's answers are written once, so nothing is asked twice, whatever a later stage reads. Many tables (``tid``) are filled at once.
"""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.tables import mostly_filled
from quire.session import written

CELL = ["tid", "i", "j"]


class Sources(Protocol):
    """What the stages ask. Columns come as ``tid``, ``j``, ``column``; cells as ``tid``, ``i``, ``name``, ``j``, ``column`` and what the stage settled of their column."""

    def own_columns(self, columns: DataFrame) -> DataFrame: ...  # tid, j, table, col: columns that the rows' own table holds

    def labels(self, columns: DataFrame) -> DataFrame: ...  # tid, j, label: columns that entries state under a label

    def entries(self, cells: DataFrame) -> DataFrame: ...  # tid, i, j, text: of cells with a label

    def derived(self, cells: DataFrame) -> DataFrame: ...  # tid, i, j, text: read off the row's own cells

    def searched(self, columns: DataFrame) -> DataFrame: ...  # tid, j, table, col: from each column's own search

    def pooled(self, columns: DataFrame) -> DataFrame: ...  # tid, j, table, col: from every table that any search found

    def table_cells(self, cells: DataFrame) -> DataFrame: ...  # tid, i, j, text: of cells with a table and col, their rows matched by name

    def beside(self, cells: DataFrame) -> DataFrame: ...  # tid, i, j, text: filled cells with values looked up beside their items


class Filling:
    """The state of the tables: columns settled, cells filled, and how many columns or cells each stage ``asked`` about."""

    def __init__(self, rows: DataFrame, columns: DataFrame):
        self.columns = written(columns.select("tid", "j", "column"))
        self.grid = written(rows.select("tid", "i", "name").join(self.columns, "tid"))
        self.settled: list[DataFrame] = []
        self.filled: list[DataFrame] = []
        self.asked: list[DataFrame] = []

    def open_columns(self) -> DataFrame:
        return reduce(lambda left, done: left.join(done, ["tid", "j"], "left_anti"), self.settled, self.columns)

    def open_cells(self) -> DataFrame:
        return reduce(lambda left, done: left.join(done, CELL, "left_anti"), self.filled, self.grid)

    def note(self, stage: str, asked: DataFrame) -> DataFrame:
        """``asked`` as it is asked, counted by table."""
        held = written(asked)
        self.asked.append(held.groupBy("tid").agg(F.count("*").alias("asked")).withColumn("stage", F.lit(stage)))
        return held

    def settle(self, found: DataFrame) -> DataFrame:
        """Columns that a stage found a source for; a column has one."""
        kept = written(found.dropDuplicates(["tid", "j"]))
        self.settled.append(kept.select("tid", "j"))
        return kept

    def fill(self, stage: str, found: DataFrame) -> None:
        """Cells that a stage gives a text for; what is filled stays."""
        good = found.where("text is not null and text <> ''").join(self.open_cells().select(CELL), CELL, "left_semi").dropDuplicates(CELL)
        self.filled.append(written(good.select(*CELL, "text", F.lit(stage).alias("stage"))))


def compose(rows: DataFrame, columns: DataFrame, sources: Sources, annotated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every cell with its ``text`` and the ``stage`` that gave it (null where none did), and what each stage was ``asked`` by table.

    Stages: the rows' own table; labels of entries; the rows' own cells, taken for columns that they state for most rows; each other column's own search; every table found, for those still
    without a source; what the own cells gave besides; the own cells of columns never asked of them, where a gap is left; and values beside the items of ``annotated`` columns (``tid``, ``j``).
    """
    f = Filling(rows, columns)

    def from_tables(stage: str, placed: DataFrame) -> None:
        cells = f.note(f"{stage} cells", f.open_cells().join(placed.select("tid", "j", "table", "col"), ["tid", "j"]))
        f.fill(stage, sources.table_cells(cells))

    from_tables("own table", f.settle(sources.own_columns(f.note("own table", f.open_columns()))))

    labelled = f.settle(sources.labels(f.note("entries", f.open_columns())))
    f.fill("entries", sources.entries(f.note("entries cells", f.open_cells().join(labelled.select("tid", "j", "label"), ["tid", "j"]))))

    own = f.note("own cells", f.open_cells().join(f.open_columns().select("tid", "j"), ["tid", "j"], "left_semi"))
    derived = written(sources.derived(own).select(*CELL, "text"))
    held = own.select(CELL).join(derived, CELL, "left").select("tid", "j", F.coalesce("text", F.lit("")).alias("cell"))
    most = mostly_filled(held.select(F.struct("tid", "j").alias("of"), F.lit(0).alias("col"), "cell"), "of").select("of.tid", "of.j")
    f.settle(most)
    f.fill("own cells", derived.join(most, ["tid", "j"], "left_semi"))

    found = f.settle(sources.searched(f.note("searches", f.open_columns())))
    found = found.select("tid", "j", "table", "col").unionByName(f.settle(sources.pooled(f.note("other tables", f.open_columns()))).select("tid", "j", "table", "col"))
    from_tables("searches", found)
    f.fill("own cells", derived)
    never = f.open_cells().join(own.select("tid", "j").distinct(), ["tid", "j"], "left_anti")
    f.fill("gaps", sources.derived(f.note("gaps", never)))

    every = reduce(DataFrame.unionByName, f.filled)
    cells = f.grid.join(every, CELL, "left")
    if annotated is not None:
        asked = f.note("annotation", cells.where("text is not null").join(annotated.select("tid", "j"), ["tid", "j"], "left_semi"))
        more = sources.beside(asked).select(*CELL, F.col("text").alias("more"))
        cells = cells.join(more, CELL, "left").withColumn("text", F.coalesce("more", "text")).drop("more")
    return cells.select(*CELL, "name", "column", "text", "stage"), reduce(DataFrame.unionByName, f.asked)
