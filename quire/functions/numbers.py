"""Numbers in digits and words, sizes, and short display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of numbers, and what a figure looks like. A figure may carry a unit behind it, never a letter before it.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALE = {"hundred": 100, "thousand": 1_000, "million": 1_000_000}
_WORD = "(?:" + "|".join([*_ONES, *_TENS, *_SCALE]) + ")"
IN_DIGITS, IN_WORDS = r"\d[\d,]*(?:\.\d+)?", f"{_WORD}(?:[ -](?:and[ -])?{_WORD})*"
FIGURE = f"(?i)(?<![A-Za-z0-9_.]){IN_DIGITS}|(?<![A-Za-z0-9_]){IN_WORDS}(?![A-Za-z0-9_])"

_SMALL = {w: i for i, w in enumerate(_ONES)} | {w: 20 + 10 * i for i, w in enumerate(_TENS)}


def _table(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def words_to_number(words: Column) -> Column:
    """The number that English words spell ("two hundred and five thousand twelve"), in one fold over the words that carries what is complete and
    the run that a scale may still multiply; null where another word stands, where there is none, and beyond 64 bits."""
    state = lambda total, run: F.struct(total.alias("total"), run.alias("run"))
    small, scale = _table(_SMALL), _table(_SCALE)

    def step(acc: Column, w: Column) -> Column:
        # a run that left 64 bits is null and stays so
        scaled = F.try_multiply(F.when(acc["run"] < 1, F.lit(1).cast("long")).otherwise(acc["run"]), F.try_element_at(scale, w).cast("long"))
        return (
            F.when(w == "and", acc)
            .when(w == "hundred", state(acc["total"], scaled))
            .when(w.isin("thousand", "million"), state(F.try_add(acc["total"], scaled), F.lit(0).cast("long")))
            .otherwise(state(acc["total"], F.try_add(acc["run"], F.try_element_at(small, w).cast("long"))))
        )

    tokens = F.filter(F.split(F.lower(words), "[ -]+"), lambda w: w != "")
    zero = F.lit(0).cast("long")
    # a scale ends a run and its nulls, so a word that is no number is looked for by itself
    known = ~F.exists(tokens, lambda w: ~w.isin(*_SMALL, *_SCALE, "and"))
    return F.when(known & (F.size(tokens) > 0), F.aggregate(tokens, state(zero, zero), step, lambda acc: F.try_add(acc["total"], acc["run"])))


def figure_parts(line: Column) -> Column:
    """A line, its white space single, cut before each figure: the text before the first, then for each figure ``raw`` and the ``text`` up to the next."""
    flat = F.trim(F.regexp_replace(F.translate(line, "\u0001\u0002", "  "), r"\s+", " "))
    marked = F.split(F.regexp_replace(flat, FIGURE, "\u0001$0\u0002"), "\u0001")
    return F.transform(marked, lambda x: F.struct(F.when(F.contains(x, F.lit("\u0002")), F.substring_index(x, "\u0002", 1)).alias("raw"), F.replace(x, F.lit("\u0002"), F.lit("")).alias("text")))


def figure_value(raw: Column) -> Column:
    """Digits without their separators, words as the number they spell."""
    return F.when(raw.rlike(r"^\d"), F.replace(raw, F.lit(","), F.lit(""))).otherwise(words_to_number(raw).cast("string"))


def spelled(n: Column) -> Column:
    """0 to 999999999 in English words."""
    ones, tens = F.array(*[F.lit(w) for w in _ONES]), F.array(*[F.lit(w) for w in _TENS])

    def small(x: Column) -> Column:
        last = x % 100
        two = F.when(last < 20, F.element_at(ones, (last + 1).cast("int"))).otherwise(F.concat(F.element_at(tens, (F.floor(last / 10) - 1).cast("int")), F.when(last % 10 > 0, F.concat(F.lit("-"), F.element_at(ones, (last % 10 + 1).cast("int")))).otherwise("")))
        return F.when(x < 100, two).otherwise(F.concat(F.element_at(ones, (F.floor(x / 100) + 1).cast("int")), F.lit(" hundred"), F.when(last > 0, F.concat(F.lit(" and "), two)).otherwise("")))

    parts = [(F.floor(n / 1_000_000), " million"), (F.floor(n / 1000) % 1000, " thousand"), (n % 1000, "")]
    return F.when(n == 0, "zero").otherwise(F.array_join(F.array_compact(F.array(*[F.when(x > 0, F.concat(small(x), F.lit(name))) for x, name in parts])), " "))


def bytes_shown(n: Column) -> Column:
    """B below 1024, else KB or MB in whole units."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.floor(n / 1024).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.floor(n / (1 << 20)).cast("string"), F.lit(" MB")))


def tokens_shown(n: Column) -> Column:
    """Whole below a thousand, else thousands with one decimal cut off."""
    return F.when(n < 1000, n.cast("string")).otherwise(F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.floor(n % 1000 / 100).cast("string"), F.lit("k")))
