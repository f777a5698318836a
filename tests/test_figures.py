"""Figures in digits and words, with their places and what stands around them."""

import pytest
from pyspark.sql import functions as F

from quire.functions import numbers
from quire.operators import figures


def found(spark, text, **options):
    rows = spark.createDataFrame([(1, i, line) for i, line in enumerate(text.split("\n"))], "page int, ln int, line string")
    return figures.figures(rows, ["page"], **options).orderBy("ln", "at").collect()


@pytest.mark.parametrize(("text", "values"), [
    ("Price 45 coins, 3,400 in all, 7.25 kilos.", ["45", "3400", "7.25"]),
    ("three hundred bolts, forty nuts, thirty-two gears, two thousand and nine pins", ["300", "40", "32", "2009"]),
    ("1,2345 and 9, then", ["12345", "9"]),
    ("Twenty-Five or two hundred and five thousand twelve; a million", ["25", "205012", "1000000"]),
    ("a v1.2, q45 and Mk7", []),
    ("Long Bow 8B or 12cm", ["8", "12"]),
    ("none of it, someone, tenfold", []),
    ("7 and 7 again\n7 here\n7 there\n7 once more", ["7", "7", "7"]),
    ("million million", ["2000000"]), (" ".join(["hundred"] * 12), []),
    ("", []), ("   ", []),
])
def test_values(spark, text, values):
    assert [r.value for r in found(spark, text)] == values


def test_a_line_is_its_own_context(spark):
    rows = found(spark, "Reach 6 most\nLong   Bow 6D\nSling 6D 61")
    assert [(r.ln, r.value, r["at"], r.context) for r in rows] == [(0, "6", 6, "Reach 6 most"), (1, "6", 9, "Long Bow 6D"), (2, "6", 6, "Sling 6D 61"), (2, "61", 9, "Sling 6D 61")]
    assert [r.context for r in found(spark, "abcdef 1 ghijkl two mnopqr", around=4)] == ["def 1 ghi", "jkl two mno"]


def test_long_lines(spark):
    line = " ".join(f"n {i}" for i in range(30_000))
    rows = found(spark, line, rows_a_value=1, around=10)
    assert len(rows) == 30_000 and rows[12_345].context == line[rows[12_345]["at"] - 10 : rows[12_345]["at"] + 15].strip()


@pytest.mark.parametrize(("words", "value"), [
    ("zero", 0), ("hundred", 100), ("One Hundred", 100), ("two hundred and five thousand twelve", 205_012), ("one million two", 1_000_002),
    ("and", 0), ("two bolts", None), ("", None), (None, None), ("nine million million", 10_000_000), (" ".join(["hundred"] * 12), None),
])
def test_words(spark, words, value):
    assert spark.createDataFrame([(words,)], "w string").select(numbers.words_to_number(F.col("w")).alias("n")).head().n == value


def test_spelled_numbers_come_back(spark):
    rows = spark.range(0, 3_000_000, 997).select("id", numbers.words_to_number(numbers.spelled(F.col("id"))).alias("n"))
    assert rows.where("not (id <=> n)").count() == 0
