"""Every question against every row of its book, by matrix products inside the tasks.

``held`` has ``book``, ``page`` (a whole number) and ``v`` (null for a page without one; a page may have many), ``asked`` has ``book``, ``qid`` (a whole number) and ``v``. Both are
dealt to blocks by a hash of their id and each block is packed into a row; a pair of blocks of a book is then a row of a join on book and block, so that no book, however large, is
one task's work, and a task holds one pair of blocks and the products of ``AT_ONCE`` questions.

Products of unit vectors are a few last places off the cosine that SQL adds up from left to right; where that could change a millionth the cosine is computed again in SQL's order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import small_batches

# Vectors and questions of a block (in the mean), questions multiplied at once, how near (in millionths) to a rounding edge a cosine is computed again, what a pair without a cosine has, tasks a core.
VECTORS, QUESTIONS, AT_ONCE, EDGE, NONE, TASKS_A_CORE = 4096, 1024, 128, 1e-6, -1_000_000, 8
_SELF = -(1 << 40)


def _packed(rows: DataFrame, key: str, most: int, into: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` a block a row (``book``, ``block``, array ``into``), and each book's number of ``blocks``."""
    sizes = rows.groupBy("book").agg(F.ceil(F.count("*") / F.lit(most)).cast("long").alias("blocks"))
    own = [c for c in rows.columns if c != "book"]
    dealt = rows.join(F.broadcast(sizes), "book").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")))  # a row a book
    # by number: pairs of blocks are much work on few bytes, so Spark is not to put partitions together by their size
    context = rows.sparkSession.sparkContext
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * context.defaultParallelism)
    return dealt.repartition(tasks, "book", "block").groupBy("book", "block").agg(F.collect_list(F.struct(*own)).alias(into)), sizes


def _meet(held: DataFrame, asked: DataFrame, out: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    small_batches(held.sparkSession)
    rows, sizes = _packed(held, "page", VECTORS, "rows")
    questions, _ = _packed(asked, "qid", QUESTIONS, "asked")
    everywhere = questions.drop("block").join(F.broadcast(sizes), "book").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    return rows.join(everywhere, ["book", "block"]).select("book", "rows", "asked").mapInArrow(run, out)


def _vectors(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors, the same over their lengths, and which have one: null and zero vectors are zeros and have none."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    given = np.zeros((len(column), len(values) // max(int(there.sum()), 1)))
    given[there] = values.reshape(-1, given.shape[1]) if len(values) else 0.0
    size = np.sqrt((given * given).sum(axis=1))
    good = size > 0
    return given, given / np.where(good, size, 1.0)[:, None], good


def _cosines(one: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of a vector with ``rows``, added up from left to right as SQL does."""
    dot, a, b = np.zeros(len(rows)), 0.0, np.zeros(len(rows))
    for k, x in enumerate(one):
        dot, a, b = dot + x * rows[:, k], a + x * x, b + rows[:, k] * rows[:, k]
    return np.divide(dot, np.sqrt(a * b), out=np.full(len(rows), -np.inf), where=b > 0)


def _scored(batch: pa.RecordBatch, i: int, but_self: bool = False) -> Iterator[tuple[pa.StructArray, np.ndarray, np.ndarray]]:
    """Some questions of the ``i``-th pair of blocks at a time, the block's different pages in order, and the millionths of each with each."""
    rows, asked = batch["rows"][i].values, batch["asked"][i].values
    number = rows.field("page").to_numpy()
    order = np.argsort(number, kind="stable")
    pages, starts = np.unique(number[order], return_index=True)
    ends = np.append(starts[1:], len(number))
    given, unit, good = (x[order] for x in _vectors(rows.field("v")))
    q_given, q_unit, q_good = _vectors(asked.field("v"))
    if not (given.shape[1] and q_given.shape[1]):  # a block without any vector
        given, unit, q_given, q_unit = (np.zeros((len(x), 1)) for x in (given, unit, q_given, q_unit))
    for at in range(0, len(asked), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        c = q_unit[part] @ unit.T
        c[:, ~good] = -np.inf
        c[~q_good[part]] = -np.inf
        if len(pages) < len(number):
            c = np.maximum.reduceat(c, starts, axis=1)
        none = c == -np.inf
        c[none] = 0.0
        x = c * 1e6 + 0.5
        micro = np.floor(x)
        for q, p in zip(*np.nonzero(np.abs(x - np.rint(x)) < EDGE), strict=True):
            if not none[q, p]:
                micro[q, p] = np.floor(_cosines(q_given[at + q], given[starts[p] : ends[p]]).max() * 1e6 + 0.5)
        micro[none] = NONE
        if but_self:
            ids = asked.field("qid").to_numpy()[part]
            place = np.minimum(np.searchsorted(pages, ids), len(pages) - 1)
            same = np.nonzero(pages[place] == ids)[0]
            micro[same, place[same]] = _SELF
        yield asked.slice(at, AT_ONCE), pages, micro.astype(np.int64)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def similar(held: DataFrame, asked: DataFrame, most: int | None = None, but_self: bool = False) -> DataFrame:
    """``qid``, ``book``, ``page`` and ``micro`` (the best vector's cosine in millionths, half up; -1000000 without one) of every question with every page of its book. With ``most``
    only those that can be among a question's ``most`` best (the nearest, then the first page): a few from every block, to be ranked by the caller. With ``but_self`` a question doesn't meet
    the page of its own number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for asked, pages, micro in _scored(batch, i, but_self):
                    ids, n = asked.field("qid").to_numpy(), len(pages)
                    if most is None or most >= n:
                        q, p, m = np.repeat(ids, n), np.tile(pages, len(ids)), micro.ravel()
                    else:
                        key = np.partition(micro * n + (n - 1 - np.arange(n)), n - most, axis=1)[:, n - most :]
                        q, p, m = np.repeat(ids, most), pages[n - 1 - key % n].ravel(), (key // n).ravel()
                    if but_self:
                        other = m != _SELF
                        q, p, m = q[other], p[other], m[other]
                    yield pa.RecordBatch.from_pydict({"qid": pa.array(q), "book": pa.repeat(batch["book"][i], len(q)), "page": pa.array(p), "micro": pa.array(m)})

    return _meet(held.select("book", "page", "v"), asked.select("book", "qid", "v"), f"qid {_type(asked, 'qid')}, book {_type(held, 'book')}, page {_type(held, 'page')}, micro long", run)


def ahead(held: DataFrame, asked: DataFrame) -> DataFrame:
    """For each question with a ``micro`` and a ``page`` (null: none) how many other rows of its book come before it (``ahead``: nearer, or as near with a smaller number), and how many others it
    ``met``: counted a block, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for asked, pages, micro in _scored(batch, i, but_self=True):
                    bar, place = (asked.field(c).fill_null(0).to_numpy()[:, None] for c in ("micro", "page"))
                    before = ((micro > bar) | ((micro == bar) & (pages[None, :] < place))) & (micro != _SELF)
                    yield pa.RecordBatch.from_pydict({"qid": asked.field("qid"), "ahead": pa.array(before.sum(axis=1)), "met": pa.array((micro != _SELF).sum(axis=1))})

    found = _meet(held.select("book", "page", "v"), asked.select("book", "qid", "v", "micro", "page"), f"qid {_type(asked, 'qid')}, ahead long, met long", run)
    return found.groupBy("qid").agg(F.sum("ahead").alias("ahead"), F.sum("met").alias("met"))
