"""Sources over real files, and runs that no SQL expresses."""

import random

from pyspark.sql import functions as F

from quire.functions.text import sentences
from quire.operators import windows
from quire.sources import shelf


def test_files(spark, tmp_path):
    for name, data in (("a.pdf", b"x"), ("b/c.pdf", b""), ("b/d.txt", b"y")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files, more = shelf.listing(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in files.collect()] == ["a.pdf", "c.pdf"] and more.head().truncated is False
    assert [r.path.rsplit("/", 1)[1] for r in shelf.nonempty(files).collect()] == ["a.pdf"]
    assert shelf.listing(spark, str(tmp_path), most=1)[1].head().truncated is True
    rows = spark.createDataFrame([("  one ",), ("",), ("two",)], "value string")
    assert [r.path for r in shelf.path_list(rows).collect()] == ["one", "two"]


def test_split_pages(spark):
    df = spark.createDataFrame([("x", "a\fb\f\fc\f"), ("y", ""), ("z", "only")], "book string, text string")
    got = [(r.book, r.page, r.text) for r in shelf.split_pages(df).orderBy("book", "page").collect()]
    assert got == [("x", 1, "a"), ("x", 2, "b"), ("x", 3, ""), ("x", 4, "c"), ("y", 1, ""), ("z", 1, "only")]


def test_page_numbers_over_blocks(spark):
    rows = [(7 * i, "ab"[i % 3 == 0]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = {(r.source, r.doc_id): r.page for r in shelf.numbered(df, "source", "doc_id", "page", block=64).collect()}
    assert got == {(s, d): i for s in "ab" for i, (d, _) in enumerate([r for r in rows if r[1] == s], start=1)}


def test_best_runs(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randint(0, 100)) for g in range(20) for i in range(15)]
    df = spark.createDataFrame(rows, "g int, pos int, share long")
    single = {r.g: (r.start, r.end, r.gain) for r in windows.best_run(df, "g", "pos", "share").collect()}
    every = {}
    for r in windows.best_runs(df, "g").collect():
        every.setdefault(r.g, []).append((r.start, r.end, r.gain))
    for g, own in every.items():
        assert max(own, key=lambda x: (x[2], -x[1])) == single[g]
        assert all(b <= c for (_, b, _), (c, _, _) in zip(own, own[1:], strict=False))
        assert all(gain >= 25 for *_, gain in own) or len(own) == 1


def test_sentences(spark):
    df = spark.createDataFrame([("One two. Three! See 2. below? Yes",)], "s string")
    assert df.select(sentences(F.col("s")).alias("u")).head().u == ["One two.", "Three!", "See 2. below?", "Yes"]
