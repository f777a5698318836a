"""URL filters: host and path rules first, then the ratio of two character language models, in DataFrame operations only.

Urls that a rule allows or blocks train two character models (host and path, lower-cased) whose order varies with what was
seen: the probability of a character after its last three interpolates orders 3 to 0 by Witten-Bell smoothing, an unseen
context passing to the next shorter one. A url's score is the difference of its log likelihoods a character. A fifth of
the labelled urls (by hash) is left out of the counts; on them the threshold is set where the two error rates together are
least.

Different urls are scored once each. Probabilities are resolved for each different 4-gram, so hot n-grams (``http``) are one
row there; the one large join, of urls' 4-grams with those, is an equi-join that Spark broadcasts only if its measured size
allows and otherwise splits where it is skewed. The model grows with the corpus and is never collected.

Defined cases: a null url, or one without ``://``, has an empty host and path; an empty host and path are allowed unless a
rule says otherwise; where one class has no labelled url every score is 0 and every url without a rule is allowed; repeated
rows and null ids are kept, and columns of any name, but those called as the results give way to them; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import written

ORDER = 3
_START, _END = "\u0002", "\u0003"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. ``rules``: (verdict, host and path prefix), as ("block", "net/es/")."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, prefix = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(prefix))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(strings: DataFrame) -> DataFrame:
    padded = F.concat(F.lit(_START * ORDER), "string", F.lit(_END))
    return strings.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.length("string") + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))))


def _log_ratio(counts: DataFrame) -> DataFrame:
    """``gram`` and ``ratio``: log of the last character's probability after the others, accepted over rejected."""
    sides = ("accepted", "rejected")
    out = counts.select("gram")
    totals = counts.agg(*[F.sum(s).alias(s) for s in sides]).head()
    chars = counts.select(F.substring("gram", ORDER + 1, 1).alias("c")).distinct().count() + 1
    p = {}
    for order in range(ORDER + 1):
        own, context = f"own{order}", f"context{order}"
        gram = counts.withColumn(own, F.substring("gram", ORDER + 1 - order, order + 1)).groupBy(own).agg(*[F.sum(s).alias(f"{s}_{own}") for s in sides])
        out = out.withColumn(own, F.substring("gram", ORDER + 1 - order, order + 1)).join(gram, own, "left")
        if order:
            ahead = gram.groupBy(F.substring(own, 1, order).alias(context)).agg(*[x for s in sides for x in (F.sum(f"{s}_{own}").alias(f"{s}_n{order}"), F.count(F.when(F.col(f"{s}_{own}") > 0, 1)).alias(f"{s}_t{order}"))])
            out = out.withColumn(context, F.substring("gram", ORDER + 1 - order, order)).join(ahead, context, "left")
        for s in sides:
            seen = F.coalesce(F.col(f"{s}_{own}"), F.lit(0))
            if order == 0:
                p[s] = (seen + 1) / F.lit(float((totals[s] or 0) + chars))
            else:
                n, t = F.coalesce(F.col(f"{s}_n{order}"), F.lit(0)), F.coalesce(F.col(f"{s}_t{order}"), F.lit(0))
                p[s] = F.when(n > 0, (seen + t * F.col(f"p_{s}")) / F.nullif(n + t, F.lit(0))).otherwise(F.col(f"p_{s}"))
        out = out.withColumns({f"p_{s}": p[s] for s in sides})
    return out.select("gram", (F.ln("p_accepted") - F.ln("p_rejected")).alias("ratio"))


def scores(strings: DataFrame) -> DataFrame:
    """``score`` of each different ``string``; ``verdict`` (allow, block or null) and ``held`` say which ones train."""
    train = {"allow": "accepted", "block": "rejected"}
    used = [F.when((F.col("verdict") == v) & ~F.col("held"), 1).otherwise(0).alias(s) for v, s in train.items()]
    counts = written(_grams(strings.select("string", *used)).groupBy("gram").agg(*[F.sum(s).alias(s) for s in train.values()]))
    ratios = written(_log_ratio(counts))
    return _grams(strings.select("string")).join(ratios, "gram").groupBy("string").agg(F.avg("ratio").alias("score"))


def threshold(scored: DataFrame) -> float | None:
    """The score that parts held-out allowed from blocked urls with the least sum of error rates, half way to the
    next score there (None without both)."""
    step, end = 0.01, 2000
    bins = scored.where("held and verdict is not null").groupBy(F.least(F.greatest(F.floor(F.col("score") / step), F.lit(-end)), F.lit(end)).alias("bin"))
    bins = bins.agg(F.count(F.when(F.col("verdict") == "allow", 1)).alias("allow"), F.count(F.when(F.col("verdict") == "block", 1)).alias("block"))
    every, upto = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("bin")  # at most 4001 rows
    miss = F.try_divide(F.sum("allow").over(upto), F.sum("allow").over(every)) + 1 - F.try_divide(F.sum("block").over(upto), F.sum("block").over(every))
    bins = bins.withColumns({"miss": miss, "next": F.coalesce(F.lead("bin").over(upto), F.col("bin") + 1)})
    best = bins.where("miss is not null").orderBy("miss", "bin").head()
    return None if best is None else (best["bin"] + 1 + best["next"]) / 2 * step


def judge(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (null where a rule decides)."""
    taken = {"host", "path", "rule", "verdict", "score"} & set(pages.columns)
    given = pages.drop(*taken)
    host, path = host_and_path(F.col(url_col))
    given = given.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    given = given.withColumns({"rule": rule, "__ruled": verdict, "__string": F.lower(F.concat("host", "path"))})
    given = written(given)
    strings = given.where("__string <> ''").groupBy(F.col("__string").alias("string")).agg(F.min("__ruled").alias("verdict"), F.max("__ruled").alias("other"))
    strings = strings.withColumn("verdict", F.when(F.col("verdict") == F.col("other"), F.col("verdict"))).drop("other").withColumn("held", F.pmod(F.xxhash64("string"), F.lit(5)) == 0)
    strings = written(strings)
    scored = written(strings.join(scores(strings), "string"))
    cut = threshold(scored)
    # urls without host and path have no score, and no part in the join
    named = given.where("__string <> ''").join(scored.select(F.col("string").alias("__string"), "score"), "__string", "left").drop("__string")
    out = named.unionByName(given.where("__string = ''").drop("__string").withColumn("score", F.lit(None).cast("double")))
    learned = F.when(F.col("score") < F.lit(cut), F.lit("block")).otherwise(F.lit("allow")) if cut is not None else F.lit("allow")
    return out.withColumns({"verdict": F.coalesce("__ruled", learned), "score": F.when(F.col("__ruled").isNull(), F.col("score"))}).drop("__ruled")
