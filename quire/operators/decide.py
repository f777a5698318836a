"""The decision step: tables of asks in, tables of answers out, and the folds that read the answers.

A *decider* takes asks (``ask_id``, ``option``, ``pos``, ``instruction``, ``state``) and returns answers (``ask_id``, ``option``, ``pos``, ``p``).
``Lexical`` is rule-based and deterministic (it replaces a model, it does not imitate one), ``Recorded`` joins given answers,
``Remote`` calls a function on batches of asks within each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import stems
from quire.session import written

ASKS_A_CALL, RANKED_A_CALL, MOST_OPTIONS = 150, 40, 255
NOT_STATED = "not stated"


class Decider(Protocol):
    def answers(self, asks: DataFrame) -> DataFrame: ...


def overlap(question: Column, text: Column) -> Column:
    """Share of the question's different stems that the text has, in whole hundredths over 100."""
    own = F.array_distinct(stems(question))
    held = F.size(F.array_intersect(own, stems(text)))
    return F.floor(held * 100 / F.greatest(F.size(own), F.lit(1)) + 0.5) / 100


class Lexical:
    """p of an option is the overlap of the instruction with the option and the state."""

    def answers(self, asks: DataFrame) -> DataFrame:
        return asks.select("ask_id", "option", "pos", overlap(F.col("instruction"), F.concat_ws(" ", "option", "state")).alias("p"))


class Recorded:
    """Given answers by ask and option; what was not recorded has p 0."""

    def __init__(self, recorded: DataFrame):
        self.recorded = recorded.select("ask_id", "option", "p")

    def answers(self, asks: DataFrame) -> DataFrame:
        return asks.select("ask_id", "option", "pos").join(self.recorded, ["ask_id", "option"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


class Remote:
    """``call`` answers a pandas table of at most ``most`` asks with a column ``p``; it runs inside the tasks, and equal asks are asked once."""

    def __init__(self, call: Callable[[pd.DataFrame], pd.Series], most: int = ASKS_A_CALL):
        self.call, self.most = call, most

    def answers(self, asks: DataFrame) -> DataFrame:
        call, most = self.call, self.most

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for a in range(0, len(frame), most):
                    part = frame.iloc[a : a + most]
                    yield part.assign(p=list(call(part)))[["instruction", "state", "option", "p"]]

        once = asks.select("instruction", "state", "option").distinct().mapInPandas(run, "instruction string, state string, option string, p double")
        return asks.join(once, ["instruction", "state", "option"], "left").select("ask_id", "option", "pos", "p")


def noul(answers: DataFrame) -> DataFrame:
    """P(yes) of each ask."""
    return answers.where("option = 'yes'").groupBy("ask_id").agg(F.max("p").alias("p"))


def choice(answers: DataFrame) -> DataFrame:
    """The likeliest option of each ask, the first on ties."""
    return answers.groupBy("ask_id").agg(F.max(F.struct("p", (-F.col("pos")).alias("back"), "option")).alias("b")).select("ask_id", F.col("b.option").alias("option"), F.col("b.p").alias("p"))


def score(answers: DataFrame) -> DataFrame:
    """Expected level (an option's place from 0) and confidence of each ask; an ask's levels share a probability of 1."""
    return answers.groupBy("ask_id").agg(F.sum(F.col("pos") * F.col("p")).alias("score"), F.max("p").alias("confidence"))


def batch_ids(asks: DataFrame, by: str, order: str, most: int = RANKED_A_CALL) -> DataFrame:
    """Calls of at most ``most`` asks within ``by``, in order."""
    return asks.withColumn("call", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / most))


NONE = "none of these"


def _called(asks: DataFrame, decider: Decider, nth: int, by: list[str]) -> DataFrame:
    """``asks`` with ``p``: a call for each of ``by``, under an id of its own in every round, so that what is asked again is answered anew."""
    call = F.concat_ws("#", "ask_id", F.lit(str(nth)), *[F.col(c).cast("string") for c in by if c != "ask_id"])
    called = asks.withColumn("call", call)
    given = decider.answers(called.select(F.col("call").alias("ask_id"), "option", "pos", "instruction", "state"))
    return called.join(given.select(F.col("ask_id").alias("call"), "option", "p"), ["call", "option"])


def _with_none(asks: DataFrame, by: list[str]) -> DataFrame:
    """A last option for none of them in each of ``by``."""
    none = asks.groupBy(*by).agg((F.max("pos") + 1).alias("pos"), F.max("instruction").alias("instruction"), F.max("state").alias("state"))
    return asks.select(*by, "option", "pos", "instruction", "state").unionByName(none.withColumn("option", F.lit(NONE)))


def tournament(asks: DataFrame, decider: Decider, heat: int = 15, most_rounds: int = 12) -> DataFrame:
    """Choices among more options than a call takes: heats of ``heat`` in place order, each with "none of these"; the heats' winners are asked anew, in heats again while
    they are more than ``heat`` + 1, else together. ``p`` is that of an option's last call, 0 for all that left before, and ``rounds`` the calls it was in.

    What is left after a round is a written table: a round is a job over it, whatever the number of asks."""
    left, done = written(asks.select("ask_id", "option", "pos", "instruction", "state")), None
    for nth in range(1, most_rounds + 1):
        size = F.count("*").over(Window.partitionBy("ask_id"))
        place = F.row_number().over(Window.partitionBy("ask_id").orderBy("pos"))
        rows = left.withColumns({"n": size, "heat": F.floor((place - 1) / heat)})
        finals = _called(rows.where(F.col("n") <= heat + 1), decider, nth, ["ask_id"])
        heats = _called(_with_none(rows.where(F.col("n") > heat + 1), ["ask_id", "heat"]), decider, nth, ["ask_id", "heat"])
        best = heats.groupBy("ask_id", "heat").agg(F.max_by("option", F.struct("p", (-F.col("pos")).alias("back"))).alias("option")).where(F.col("option") != NONE)
        gone = heats.where(F.col("option") != NONE).join(best, ["ask_id", "heat", "option"], "left_anti")
        out = written(finals.select("ask_id", "option", "pos", "p").unionByName(gone.select("ask_id", "option", "pos", F.lit(0.0).alias("p"))).withColumn("rounds", F.lit(nth)))
        done = out if done is None else done.unionByName(out)
        left = written(left.join(best.select("ask_id", "option"), ["ask_id", "option"], "left_semi"))
        if left.isEmpty():
            return done
    raise ValueError(f"more than {most_rounds} rounds")


def _picks(asks: DataFrame, decider: Decider, nth: int, most: int) -> DataFrame:
    """What one round picks of each ask, ``place`` from 1: the options of a choice that get any probability; of more than ``most``, the picks of choices of ``most`` each, asked
    together again (the first ``most`` of them), those that the final gives nothing behind those it does."""
    rows = asks.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("ask_id").orderBy("pos")) - 1) / most))
    first = _called(_with_none(rows, ["ask_id", "chunk"]), decider, nth, ["ask_id", "chunk"]).where((F.col("p") > 0) & (F.col("option") != NONE))
    order = Window.partitionBy("ask_id").orderBy("chunk", F.desc("p"), "pos")
    chunks = rows.groupBy("ask_id").agg(F.max("chunk").alias("chunks"))
    first = first.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("ask_id"))).join(chunks, "ask_id")
    whole = (F.col("chunks") == 0) | (F.col("n") == 1)
    again = first.where(~whole & (F.col("k") <= most)).withColumn("at", F.col("pos")).withColumn("pos", F.col("k"))
    final = _called(_with_none(again, ["ask_id"]), decider, -nth, ["ask_id"]).where((F.col("p") > 0) & (F.col("option") != NONE)).select("ask_id", "option", F.col("p").alias("q"))
    met = first.join(final, ["ask_id", "option"], "left")
    p = F.when(whole, F.col("p")).otherwise(F.coalesce("q", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("ask_id").orderBy(F.desc(p), "k"))
    return met.withColumns({"place": place, "p": p}).select("ask_id", "option", "pos", "p", "place")


def ranked_by_choice(asks: DataFrame, decider: Decider, want: int = 12, rounds: int = 4, most: int = 254) -> DataFrame:
    """Every option of every ask ranked by choices: a round's picks are taken out and the rest is asked again until ``want`` are ranked, a round picks nothing, or after
    ``rounds``. A pick scores from 3 down to 1 by its place, what no round picked 0, in place order. ``asks`` may have a boolean ``wanted``: only such options count to ``want``."""
    if "wanted" not in asks.columns:
        asks = asks.withColumn("wanted", F.lit(True))
    every = written(asks.select("ask_id", "option", "pos", "instruction", "state", "wanted"))
    left, picked = every, None
    for nth in range(1, rounds + 1):
        got = written(_picks(left, decider, nth, most).withColumn("round", F.lit(nth)))
        picked = got if picked is None else picked.unionByName(got)
        counted = every.join(picked, ["ask_id", "option"]).groupBy("ask_id").agg(F.count_if("wanted").alias("have"), F.max("round").alias("last"))
        open_ = counted.where((F.col("have") < want) & (F.col("last") == nth)).select("ask_id")
        if nth < rounds:
            left = written(left.join(open_, "ask_id", "left_semi").join(got.select("ask_id", "option"), ["ask_id", "option"], "left_anti"))
            if left.isEmpty():
                break
    one = every.join(picked.select("ask_id", "option", "p", "round", "place"), ["ask_id", "option"], "left")
    rank = F.row_number().over(Window.partitionBy("ask_id").orderBy(F.col("round").asc_nulls_last(), "place", "pos"))
    n = F.count("round").over(Window.partitionBy("ask_id"))
    score = F.when(F.col("round").isNotNull(), 3 - 2 * (F.col("rank") - 1) / F.greatest(n, F.lit(1))).otherwise(0.0)
    return one.withColumn("rank", rank).select("ask_id", "option", "rank", "round", score.alias("score"), F.coalesce("p", F.lit(0.0)).alias("p"))


def asked_again(answers: DataFrame, bar: float, reach: float, again: DataFrame) -> DataFrame:
    """Answers within ``reach`` of the ``bar`` averaged with those of asking ``again``."""
    more = again.groupBy("ask_id", "option").agg(F.sum("p").alias("more"), F.count("*").alias("n"))
    near = F.abs(F.col("p") - bar) <= reach
    met = answers.join(more, ["ask_id", "option"], "left")
    return met.select("ask_id", "option", "pos", F.when(near & F.col("n").isNotNull(), (F.col("p") + F.col("more")) / (1 + F.col("n"))).otherwise(F.col("p")).alias("p"))
