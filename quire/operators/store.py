"""Vectors of texts kept in a table by content, and rankings kept for questions like them.

A store is a folder of parquet parts in shared storage: ``model``, ``hash`` (SHA-256 of the text), ``vector``. A text is embedded the first time it is met, whichever book, page
or question it stands in: the hashes that the store lacks are an anti-join, their texts are embedded inside the tasks, a batch at a time, and appended. A task that is lost embeds
its own texts again; what has been appended is read by every later run.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import chunks, same_words
from quire.operators import meeting
from quire.session import small_batches, written

# Characters of a chunk, texts of a call, and how many pages a shortlist is made of.
CHUNK_CHARS, TEXTS_A_CALL, SHORTLIST_PAGES = 6000, 8, 20
SCHEMA = "model string, hash binary, vector array<double>"


class Embedder(Protocol):
    """What a store is filled by: ``embed`` gives a vector for each text of a call and runs inside the tasks."""

    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Letters:
    """How often each small letter from a to z stands in a text: a rule in a model's place."""

    model = "letters"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256)[97:123].astype(float).tolist() for t in texts]


def text_hash(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class VectorStore:
    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder):
        self.spark, self.folder, self.embedder = spark, folder, embedder

    def vectors(self) -> DataFrame:
        """``hash`` and ``vector`` of this model's texts as they are now; two runs that embedded a text at once count once.

        Each fill is a folder of its own: two readings of one growing folder would be the same scan to a plan that holds both."""
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/vectors/*")
        except Exception as missing:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            rows = self.spark.createDataFrame([], SCHEMA)
        return rows.where(F.col("model") == self.embedder.model).groupBy("hash").agg(F.first("vector").alias("vector"))

    def missing(self, texts: DataFrame) -> DataFrame:
        """The different ``text``s that have no vector yet, with their ``hash``."""
        hashed = F.col("__hash") if "__hash" in texts.columns else text_hash(F.col("text"))
        own = texts.select(hashed.alias("hash"), "text").where("text is not null").dropDuplicates(["hash"])
        return own.join(self.vectors().select("hash"), "hash", "left_anti")

    def fill(self, texts: DataFrame) -> int:
        """Embed and append what is missing of ``texts``; how many that were."""
        embedder = self.embedder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                calls = (batch["text"].slice(at, TEXTS_A_CALL).to_pylist() for at in range(0, batch.num_rows, TEXTS_A_CALL))
                vectors = [v for texts in calls for v in embedder.embed(texts)]
                yield pa.RecordBatch.from_pydict({"model": pa.array([embedder.model] * len(batch), pa.string()), "hash": batch["hash"], "vector": pa.array(vectors, pa.list_(pa.float64()))})

        small_batches(self.spark)
        before = self.vectors().count()
        self.missing(texts).mapInArrow(run, SCHEMA).write.parquet(f"{self.folder}/vectors/{uuid.uuid4().hex}")
        return self.vectors().count() - before

    def of(self, texts: DataFrame) -> DataFrame:
        """``texts`` with their ``vector``s, filled first."""
        hashed = written(texts.withColumn("__hash", text_hash(F.col("text"))))  # read twice; cutting texts costs more than writing them
        self.fill(hashed)
        return hashed.withColumnRenamed("__hash", "hash").join(self.vectors(), "hash", "left").drop("hash")


def page_chunks(pages: DataFrame, chars: int = CHUNK_CHARS) -> DataFrame:
    """``book``, ``page``, ``text`` of each chunk; a page without text has none."""
    return pages.select("book", "page", F.explode(chunks(F.col("text"), chars)).alias("text"))


def similar_pages(questions: DataFrame, pages: DataFrame, store: VectorStore, chars: int = CHUNK_CHARS, most: int | None = None) -> DataFrame:
    """For each question (``qid``, ``book``, ``text``) the pages of its book by the cosine of their best chunk, in millionths (a page without text -1000000).
    With ``most`` only pages that can be among a question's ``most`` best, for a shortlist to rank."""
    every = pages.select("book", "page", F.lit(None).cast("array<double>").alias("v"))
    held = written(store.of(page_chunks(pages, chars)).select("book", "page", F.col("vector").alias("v")).unionByName(every))
    asked = written(store.of(questions).select("qid", "book", F.col("vector").alias("v")))
    return meeting.similar(held, asked, most)


def shortlist(similar: DataFrame, excerpts: DataFrame, sections: DataFrame, most: int = SHORTLIST_PAGES) -> DataFrame:
    """Sections that hold one of a question's ``most`` best pages or one of its excerpts' (``qid``, ``book``, ``page``): an equi-join on pages, as a section lists its own."""
    order = Window.partitionBy("qid", "book").orderBy(F.desc("micro"), "page")
    best = similar.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("qid", "book", "page")
    wanted = best.unionByName(excerpts.select("qid", "book", "page")).distinct()
    spans = sections.select("book", "path", "start", "end", F.explode(F.sequence("start", "end")).alias("page"))
    return spans.join(wanted, ["book", "page"]).select("qid", "book", "path", "start", "end").distinct()


def stored_rankings(kept: DataFrame, walks: DataFrame) -> DataFrame:
    """The rankings kept after ``walks``: one of a whole book, not taken from the cache itself, whose walk took an answer; it replaces what was kept for the same words.

    Both: ``book``, ``question``, ``at``, ``top`` (its best sections); ``walks`` also ``cached``, ``confined``, ``ranked`` and ``hits``."""
    fit = walks.where(~F.col("cached") & ~F.col("confined") & (F.col("ranked") > 0) & (F.col("hits") > 0))
    rows = kept.select("book", "question", "at", "top").unionByName(fit.select("book", "question", "at", "top"))
    latest = F.max_by(F.struct("question", "at", "top"), F.col("at")).alias("e")
    return rows.groupBy("book", same_words(F.col("question")).alias("words")).agg(latest).select("book", "e.question", "e.at", "e.top")
