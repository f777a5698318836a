"""Vectors by content: nothing is embedded twice, whatever run, book or question it comes from; shortlists and kept rankings."""

import pytest

from quire.operators import store
from quire.session import shared_folder


def embedders(folder):
    """One that writes a file a call (so that calls in other processes count too), one that must not be called, one of another model."""

    class Counted(store.Letters):
        def embed(self, texts):
            import pathlib
            import uuid

            pathlib.Path(folder, uuid.uuid4().hex).write_text("\n".join(texts))
            return super().embed(texts)

    class Never(store.Letters):
        def embed(self, texts):
            raise AssertionError("everything is there")

    class Other(store.Letters):
        model = "other"

    return Counted(), Never(), Other()


@pytest.fixture
def pages(spark):
    rows = [("b", 1, "aab"), ("b", 2, "zz z"), ("b", 3, " "), ("b", 4, None), ("c", 1, "aab"), ("c", 2, "x" * 25)]
    return spark.createDataFrame(rows, "book string, page int, text string")


def test_a_second_run_embeds_nothing(spark, pages, tmp_path):
    counted, never, other = embedders(str(tmp_path))
    folder, chunks = shared_folder(spark), store.page_chunks(pages, 10)
    first = store.VectorStore(spark, folder, counted)
    assert first.fill(chunks.where("book = 'b'")) == 2
    assert first.fill(chunks) == 2  # 25 characters are chunks of 9, 9 and 7
    calls = [f.read_text().split("\n") for f in tmp_path.iterdir()]
    seen = [line for call in calls for line in call]
    assert sorted(seen) == ["aab", "x" * 7, "x" * 9, "zz z"] and max(map(len, calls)) <= store.TEXTS_A_CALL
    again = store.VectorStore(spark, folder, never)
    assert again.fill(chunks) == 0
    assert {(r.book, r.page): r.vector[0] for r in again.of(chunks.where("page = 1")).collect()} == {("b", 1): 2.0, ("c", 1): 2.0}
    assert store.VectorStore(spark, folder, other).missing(chunks).count() == 4


def test_stores_grow_within_a_plan(spark, pages):
    kept = store.VectorStore(spark, shared_folder(spark), store.Letters())
    asked = spark.createDataFrame([(7, "b", "abb"), (8, "c", "q"), (9, "b", "")], "qid int, book string, text string")
    got = {(r.qid, r.book, r.page): r.micro for r in store.similar_pages(asked, pages, kept).collect()}
    assert got == {(7, "b", 1): 800000, (7, "b", 2): 0, (7, "b", 3): -1000000, (7, "b", 4): -1000000, (8, "c", 1): 0, (8, "c", 2): 0, **{(9, "b", p): -1000000 for p in (1, 2, 3, 4)}}


def test_shortlist(spark):
    similar = spark.createDataFrame([(1, "b", p, 100 - abs(p - 4)) for p in range(1, 9)], "qid int, book string, page int, micro long")
    excerpts = spark.createDataFrame([(1, "b", 8), (1, "c", 1)], "qid int, book string, page int")
    sections = spark.createDataFrame([("b", "x", 1, 2), ("b", "y", 3, 5), ("b", "y > z", 4, 4), ("b", "w", 6, 8), ("c", "x", 1, 1)], "book string, path string, start int, end int")
    assert sorted((r.book, r.path) for r in store.shortlist(similar, excerpts, sections, 1).collect()) == [("b", "w"), ("b", "y"), ("b", "y > z"), ("c", "x")]


def test_stored_rankings(spark):
    shape = "book string, question string, at int, top array<string>"
    kept = spark.createDataFrame([("b", "How many?", 1, ["x"]), ("b", "Which?", 2, ["y"])], shape)
    walks = [("b", " how  MANY? ", 5, ["z"], False, False, 3, 1), ("b", "Which?", 6, ["n"], True, False, 3, 1), ("b", "Who?", 7, ["n"], False, True, 3, 1), ("b", "Why?", 8, ["n"], False, False, 0, 1), ("b", "When?", 9, ["n"], False, False, 3, 0), ("c", "Which?", 4, ["q"], False, False, 1, 2)]
    got = store.stored_rankings(kept, spark.createDataFrame(walks, shape + ", cached boolean, confined boolean, ranked int, hits int"))
    assert sorted(tuple(r) for r in got.collect()) == [("b", " how  MANY? ", 5, ["z"]), ("b", "Which?", 2, ["y"]), ("c", "Which?", 4, ["q"])]
