"""Filter interaction audit: what each of a list of filters removes in every order, and its Shapley value.

Every document gets a mask, one bit a filter that it fails. Documents are counted by part and mask, and the coalitions of filters
are tabulated from that: what a coalition removes are the documents whose mask meets it. A coalition's table answers everything else:

- a step of an order is the difference of two coalitions (the filters up to it, and those before it);
- the Shapley value of a filter is its coefficient in the additive model that is nearest to the table by least squares, weighted by
  the Shapley kernel, with the coefficients held to add up to what all filters remove. The normal equations (with a multiplier for the
  constraint) depend on the number of filters only; they are solved once in rationals, as whole weights of the coalitions over one denominator,
  and Spark takes the weighted sum of each part's table in whole numbers.

A document counts as a repeat of a text when a smaller id has the same text (compared by SHA-256) anywhere in the table. Texts that
only one row has are not joined; those of many rows are sent out (at most 4096), so that no task gets all copies of one.

Defined cases: a null text is empty; a null id is no document that another could repeat and repeats none; rows that share an id and a text do
not repeat each other; several labels of an id count once each way (good or toxic if one of them says so); a null part is the
empty string; parts without any removal have rows of zeros; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WORD, matched, written

FILTERS = "ABCDE"
REPEAT = 16  # the bit of E


def shapley_weights(n: int) -> tuple[list[int], list[list[int]]]:
    """For each filter, whole weights of all ``2**n`` coalitions, over the denominators (one a filter) of the first list.

    With v the table and phi the coefficients: minimise the sum over the coalitions S but the empty and the full one of
    k(S) * (v(S) - phi(S))**2, where phi adds up to v(all) - v(none); k(S) = (n - 1) / (comb(n, s) * s * (n - s)).
    """
    full = 2**n - 1
    members = [[c >> i & 1 for i in range(n)] for c in range(full + 1)]
    kernel = [Fraction(0) if c in (0, full) else Fraction(n - 1, comb(n, sum(m)) * sum(m) * (n - sum(m))) for c, m in enumerate(members)]
    # the normal equations' left side, with the multiplier's row and column, beside one right side a coalition
    rows = [[sum((kernel[c] * m[i] * m[j] for c, m in enumerate(members)), Fraction(0)) for j in range(n)] + [Fraction(1)] + [kernel[c] * m[i] for c, m in enumerate(members)] for i in range(n)]
    rows.append([Fraction(1)] * n + [Fraction(0)] + [Fraction((c == full) - (c == 0)) for c in range(full + 1)])
    for i in range(n + 1):
        at = next(r for r in range(i, n + 1) if rows[r][i])
        rows[i], rows[at] = rows[at], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n + 1):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    solved = [row[n + 1 :] for row in rows[:n]]
    below = [lcm(*(x.denominator for x in row)) for row in solved]
    return below, [[int(x * d) for x in row] for row, d in zip(solved, below, strict=True)]


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at the text alone: few words, few different ones, many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    counted = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("different"))), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bit = lambda fails, n: F.when(fails, n).otherwise(0)
    by_words = F.transform(F.array(counted), lambda c: bit(c["words"] < 50, 1) + bit(100 * c["different"] < 65 * c["words"], 2))
    return F.get(by_words, F.lit(0)) + bit(100 * capitals.cast("long") > 5 * F.length(text), 4) + bit(text.rlike("[#$%&*|]"), 8)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``id``, ``part`` and ``mask`` of every document."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    rows = written(docs.select(F.col(f"`{id_col}`").alias("id"), part.alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")))
    copies = written(rows.groupBy("digest").agg(F.count("*").alias("rows"), F.min("id").alias("first")).where("rows > 1"))
    repeats = matched(rows, copies, "digest", "rows").where("id > first")
    again = repeats.groupBy("id", "digest").agg(F.lit(REPEAT).alias("again"))
    return rows.join(again, ["id", "digest"], "left").select("id", "part", (F.col("mask") + F.coalesce("again", F.lit(0))).alias("mask"))


def coalitions(counts: DataFrame, measures: list[str]) -> DataFrame:
    """``removed``: for each part an array, by coalition, of what it removes (``measures`` summed), from counts by ``part`` and ``mask``."""
    each = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))))
    meets = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    sums = each.groupBy("part", "coalition").agg(*[F.sum(F.when(meets, F.col(m)).otherwise(0)).alias(m) for m in measures], F.sum("n").alias("all"))
    table = F.sort_array(F.collect_list(F.struct("coalition", *measures)))  # a row a coalition: 32
    return sums.groupBy("part").agg(F.max("all").alias("all"), table.alias("removed"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row a part, order and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, and ``shapley`` (times the number of orders)."""
    judged = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = written(masks(docs, id_col, text_col, part_col))
    every = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    labelled = rows.join(judged, "id").groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    counts = every.unionByName(labelled)
    table = coalitions(counts, ["n", "good", "toxic"])
    orders = ["".join(p) for p in permutations(FILTERS)]
    below, weights = shapley_weights(len(FILTERS))
    full = 2 ** len(FILTERS) - 1
    removed = lambda s, what="n": F.get(F.col("removed"), s)[what]
    # every denominator divides the number of orders, so the sums over all orders are whole
    worth = [sum((removed(F.lit(c)) * w for c, w in enumerate(row) if w), F.lit(0)) * (len(orders) // d) for row, d in zip(weights, below, strict=True)]
    steps = table.withColumn("worth", F.array(*worth)).withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders)), " ")))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = lambda i: F.ascii(F.substring("filter_order", i, F.lit(1))) - ord("A")
    bit = lambda i: F.call_function("shiftleft", F.lit(1), place(i))
    after = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda acc, i: acc + bit(i))
    steps = steps.withColumns({"own": bit(F.col("step")), "filter": place(F.col("step")), "after": after})
    steps = steps.withColumn("before", F.col("after") - F.col("own"))
    step = lambda what: removed(F.col("after"), what) - removed(F.col("before"), what)
    return steps.select(
        "part", "filter_order", "step",
        (F.col("all") - removed(F.col("after"))).alias("kept"),
        step("n").alias("removed"),
        (removed(F.col("own")) - step("n")).alias("redundant"),
        (removed(F.lit(full)) - removed(F.lit(full) - F.col("own"))).alias("unique_fails"),
        step("good").alias("good_lost"),
        step("toxic").alias("toxic_lost"),
        F.get(F.col("worth"), F.col("filter")).alias("shapley"),
    )
