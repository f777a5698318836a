"""Rows as text: TSV, CSV, Markdown, citations, elided names, reports as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tsv(cells: list[Column]) -> Column:
    return F.concat_ws("\t", *[F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\t\r\n]", " ") for c in cells])


def csv(cells: list[Column]) -> Column:
    """Cells with a quote, comma or line break in quotes, quotes doubled; CRLF at the end."""
    def quoted(c: Column) -> Column:
        c = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    return F.concat(F.concat_ws(",", *[quoted(c) for c in cells]), F.lit("\r\n"))


def markdown(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|")) for c in cells]), F.lit(" |"))


def elide(name: Column, width: int) -> Column:
    """Names over ``width`` with an ellipsis in the middle, the longer half in front."""
    front, back = (width - 1 + 1) // 2, (width - 1) // 2
    return F.when(F.length(name) <= width, name).otherwise(F.concat(F.substring(name, 1, front), F.lit("…"), F.right(name, F.lit(back))))


def citation(book: Column, page: Column, path: Column) -> Column:
    return F.concat(book, F.lit(", p."), page.cast("string"), F.when(path.isNotNull(), F.concat(F.lit(" ("), path, F.lit(")"))).otherwise(F.lit("")))


def stem(question: Column, most: int = 40) -> Column:
    """A file's stem from a question: letters and digits in lower case, joined by dashes, cut at a word."""
    flat = F.trim(F.regexp_replace(F.lower(question), r"[^\p{L}\p{N}]+", " "))
    cut = F.when(F.length(flat) <= most, flat).otherwise(F.regexp_replace(F.substring(flat, 1, most + 1), r"\s*\S*$", ""))
    return F.replace(cut, F.lit(" "), F.lit("-"))
