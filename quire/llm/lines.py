"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

Every line long enough has a key (stripped, A-Z lower-cased), held as a 128-bit hash. Documents come in batches. A batch's keys are counted
first (one row a key: how many documents have it, the largest id among them), then merge-anti-joined with every run so far: what no run has
becomes a new run of level 0, what some run has goes to a ledger of counts. Runs and ledger are tables bucketed and sorted by the hash with
one number of buckets, so these joins merge sorted buckets and shuffle nothing but the batch. ``fanout`` tables of a level are compacted into
one of the next, again by a merge. No key is in two runs; its count is its run's row and its ledger rows together, whatever the order of the batches.

Frequent keys then meet the lines again (hot ones are sent out, at most 4096; the rest is shuffled by hash), and each document gets back the
positions of the lines that it loses. Texts are shuffled once, by a hash of the row; its lines are cut out in one pass, as slices between
the lost positions.

Defined cases: a null or empty text is one empty line; keys are counted once a row, however often the row holds them; rows that share the
largest id all keep a key's lines; a null id is below every other, and where only null ids hold a key nothing goes; a text whose lines all
go is empty; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import matched, written
from quire.session import shared_folder

BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class LineRuns:
    """Keys seen so far, in levelled sorted runs; ``add`` takes a batch's tallies (``h``, ``docs``, ``largest``; one row a key)."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.ledger: list[list[str]] = []
        self.tables: list[str] = []

    def _stored(self, keys: DataFrame) -> str:
        """``keys`` as a table in the shared folder, bucketed and sorted by the hash."""
        name = f"quire_run_{uuid.uuid4().hex}"
        keys.write.format("parquet").option("path", shared_folder(self.spark)).bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        self.tables.append(name)
        return name

    def _merged(self, a: DataFrame, name: str, how: str) -> DataFrame:
        """Keys of ``a`` (``full``: and of the table), their counts added up, by a merge of sorted buckets."""
        b = self.spark.table(name).select("h", F.col("docs").alias("more"), F.col("largest").alias("other")).hint("merge")
        docs = F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))
        return a.join(b, "h", how).select("h", docs.alias("docs"), F.greatest("largest", "other").alias("largest"))

    def _placed(self, levels: list[list[str]], run: str, level: int = 0) -> None:
        """``run`` at ``level``; a full level becomes one run of the next."""
        if level == len(levels):
            levels.append([])
        levels[level].append(run)
        if len(levels[level]) == self.fanout:
            full, levels[level] = levels[level], []
            merged = reduce(lambda a, name: self._merged(a, name, "full"), full[1:], self.spark.table(full[0]))
            self._placed(levels, self._stored(merged), level + 1)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, tallies: DataFrame) -> DataFrame:
        """The batch's keys that were in no run; they are a run afterwards."""
        name = self._stored(tallies.repartition(self.buckets, "h"))
        if self.runs():
            own = fresh = self.spark.table(name)
            for run in self.runs():
                fresh = fresh.join(self.spark.table(run).select("h").hint("merge"), "h", "left_anti")
            name = self._stored(fresh)
            again = own.join(self.spark.table(name).select("h").hint("merge"), "h", "left_anti")
            self._placed(self.ledger, self._stored(again))
        self._placed(self.levels, name)
        return self.spark.table(name)

    def counts(self) -> DataFrame:
        """``docs`` and ``largest`` of every key, over all batches: each run merged with the ledger."""
        ledger = [name for level in self.ledger for name in level]
        whole = [reduce(lambda a, name: self._merged(a, name, "left"), ledger, self.spark.table(run)) for run in self.runs()]
        return reduce(DataFrame.unionByName, whole)

    def forget(self) -> None:
        """Take the tables out of the catalogue (their files are in the shared folder)."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []


def line_keys(text: Column, least_chars: int) -> Column:
    """A key's MD5 for each line of ``text``, null for a line whose key has fewer than ``least_chars`` characters."""
    keys = F.transform(F.split(text, "\n"), lambda line: F.translate(F.trim(line, F.lit(BLANKS)), _UPPER, _LOWER))
    return F.transform(keys, lambda k: F.when(F.length(k) >= least_chars, F.md5(k.cast("binary"))))


def without(text: Column, gone: Column) -> Column:
    """``n_lines``, ``n_dropped`` and ``kept`` of a text that loses the lines at the sorted positions ``gone``: slices between them, one pass."""
    held = F.struct(F.split(text, "\n").alias("lines"), F.coalesce(gone, F.array().cast("array<int>")).alias("gone"))

    def between(s: Column, i: Column) -> Column:
        start = F.coalesce(F.get(s["gone"], i - 1) + 1, F.lit(0))
        return F.slice(s["lines"], start + 1, F.coalesce(F.get(s["gone"], i), F.size(s["lines"])) - start)

    def cut(s: Column) -> Column:  # in a lambda's variable: an expression would be computed again for every slice
        parts = F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["gone"])), lambda i: between(s, i)))
        return F.struct(F.size(s["lines"]).cast("long").alias("n_lines"), F.size(s["gone"]).cast("long").alias("n_dropped"), F.array_join(parts, "\n").alias("kept"))

    return F.get(F.transform(F.array(held), cut), F.lit(0))


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """The id, ``n_lines``, ``n_dropped`` and the text ``kept`` of every document, without the lines whose key at least ``least_docs``
    documents have, except in the one with the largest id."""
    spark = docs.sparkSession
    ident, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(ident.alias("id"), text.alias("text")).withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64("text", F.lit(1), "id")})
    keyed = written(rows.select("id", "k1", "k2", F.pmod("k1", F.lit(batches)).alias("batch"), line_keys(F.col("text"), least_chars).alias("keys")), "batch")
    seen = LineRuns(spark, fanout=fanout)
    for b in range(batches):
        own = keyed.where(F.col("batch") == b).select("id", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
        seen.add(own.groupBy(F.unhex("key").alias("h")).agg(F.count("*").alias("docs"), F.max("id").alias("largest")))
    frequent = written(seen.counts().where(F.col("docs") >= least_docs))
    seen.forget()
    lines = keyed.select("id", "k1", "k2", F.posexplode("keys").alias("at", "key")).where("key is not null").select("id", "k1", "k2", "at", F.unhex("key").alias("h"))
    lost = matched(lines, frequent, "h", "docs").where(~F.col("id").eqNullSafe(F.col("largest")))
    gone = lost.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    cut = rows.join(gone, ["k1", "k2"], "left").select("id", without(F.col("text"), F.col("gone")).alias("cut"))
    return cut.select(F.col("id").alias(id_col), "cut.n_lines", "cut.n_dropped", "cut.kept")
