"""Windows by their own trim, pieces of pages, names in running words, heads of tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions.text import STOPWORDS
from quire.operators import tables, windows


def windowed(pages, chars, least):
    out, buf, first = [], "", 1
    for i, page in enumerate(pages, 1):
        if buf and len(buf) + len(page) > chars:
            out.append((first, i - 1, buf))
            buf, first = "", i
        buf += page
    out.append((first, len(pages), buf))
    blanks = windows.BLANKS
    return [(a, b, len(t)) for a, b, t in out if len(t.strip(blanks)) > least]


def test_windows_trim_as_a_whole(spark):
    rng = random.Random(4)
    books = [["".join(rng.choice(" \n\t\u00a0abc") for _ in range(rng.randint(0, 12))) if rng.random() < 0.7 else " " * rng.randint(0, 9) for _ in range(rng.randint(1, 8))] for _ in range(80)]
    books.append(["\n" * 30 + "x" * 10])
    pages = spark.createDataFrame([(f"b{i}", k, t) for i, book in enumerate(books) for k, t in enumerate(book, 1)], "book string, page int, text string")
    sections = spark.createDataFrame([(f"b{i}", f"b{i}", 1, len(book)) for i, book in enumerate(books)], "book string, path string, start int, end int")
    items = windows.section_pages(pages, sections)
    got = {r.book: [(w.page, w.end, w.chars) for w in r.w] for r in items.select("book", windows.page_windows(F.col("items"), 20, 9).alias("w")).collect()}
    assert [got[f"b{i}"] for i in range(len(books))] == [windowed(b, 20, 9) for b in books]
    assert got["b80"] == [(1, 1, 40)]


def cut(text, chars):
    if len(text) <= chars:
        return [text]
    out, buf, at = [], "", 0
    end = re.compile(r"(?:[.!?]+[\"')\]]*(?=[ \t\n\x0b\f\r]|\Z)|\n[ \t]*\n|\Z)[ \t\n\x0b\f\r]*")
    while at < len(text):
        stop = end.search(text, at).end()
        run, at = text[at:stop], stop
        if buf and len(buf) + len(run) > chars:
            out.append(buf)
            buf = ""
        while len(run) > chars:
            space = run.rfind(" ", 0, chars + 1)
            n = space if space > 0 else chars
            out.append(run[:n])
            run = run[n:]
        buf += run
    return out + [buf] if buf else out


def test_pieces(spark):
    rng = random.Random(8)
    texts = ["One here. Two here! Three (is) here?) Four", "Head\n\nBody\n \nMore", "", "x" * 45, "aaaa bbbb cccc dddd.", "end.\n", "No. 5 of v2.5 \"quoted.\" yes"]
    texts += ["".join(rng.choice(["ab ", "cdef", ". ", "! ", ".) ", "\n\n", "\n", " ", "longer", "é"]) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for chars in (7, 10, 35):
        got = {r.i: r.p for r in rows.select("i", windows.pieces(F.col("t"), chars).alias("p")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == cut(t, chars), (t, chars)
            assert "".join(got[i]) == t and all(len(p) <= chars for p in got[i])


def named(words, of):
    out, i = [], 0
    ok = lambda k: words[k]["go"] and not words[k]["stop"]
    while i < len(words):
        if words[i]["stop"] or not words[i]["start"]:
            i += 1
            continue
        end = i
        while not words[end]["ends"] and end + 1 < len(words):
            if ok(end + 1):
                end += 1
            elif of and words[end + 1]["word"].lower() == "of" and end + 2 < len(words) and ok(end + 2):
                end += 2
            else:
                break
        out.append((i, end, [w["word"] for w in words[i : end + 1]]))
        i = end + 1
    return out


@pytest.mark.parametrize("of", [False, True])
def test_names_by(spark, of):
    rng, rows, texts = random.Random(6 + of), [], []
    for g in range(150):
        words = []
        for _ in range(rng.randint(1, 12)):
            word, p = rng.choice(["of", "Of", "rate", "fire", "the", "big"]), rng.random()
            words.append({"word": word, "ends": rng.random() < 0.15, "start": p > 0.5, "go": p > 0.25, "stop": word.lower() in ("of", "the")})
        texts.append(words)
        rows += [(g, i, *w.values()) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "g int, pos int, word string, ends boolean, start boolean, go boolean, stop boolean")
    got = {}
    for r in windows.names_by(df, "g", of).orderBy("g", "pos").collect():
        got.setdefault(r.g, []).append((r.pos, r.end, r.name))
    assert [got.get(g, []) for g in range(150)] == [named(w, of) for w in texts]


def test_trimmed(spark):
    rows = spark.createDataFrame([(1, 4, 7, ["the", "rate", "of", "The"]), (2, 0, 1, ["of", "the"]), (3, 2, 2, ["Axe"])], "g int, pos int, end int, name array<string>")
    assert [tuple(r) for r in windows.trimmed(rows, STOPWORDS).collect()] == [(1, 5, 5, ["rate"]), (3, 2, 2, ["Axe"])]


@pytest.mark.parametrize(("cells", "names"), [
    (["x", "x", "x 2"], ["x", "x 2", "x 2 2"]), (["", "a", ""], ["column 1", "a", "column 3"]), (["x 2", "x", "x"], ["x 2", "x 2", "x 3"]), ([], []),
])
def test_heads(spark, cells, names):
    row = spark.createDataFrame([(cells, [f"v{i}" for i in range(len(cells))])], "h array<string>, c array<string>")
    got = row.select(tables.heads_named(F.col("h")).alias("h"), tables.row_text(tables.heads_named(F.col("h")), F.col("c")).alias("t")).head()
    assert got.h == names and (len(names) < 2 or got.t.count(":") == len(set(names)))
