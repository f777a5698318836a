"""Runs followed live: NDJSON that comes in pieces, folded to each run's state by a stateful processor.

Pieces of a run (``seq`` from 1) may come in any order and in any batch, and cut lines anywhere: a piece waits until those before it are there, the rest of a line
waits for its end. A run ends once; what comes after its end is left out. A run from which nothing came for ``quiet`` seconds of event time is ``left`` by a
timer (one a bucket of runs, set to the first that is due), as one whose page was closed; a line that nothing can read ends it as ``lost``. A run's reports of its spend are totals: what each batch adds to the largest so
far is the charge. State and timers are in the checkpoint and a batch's updates replace those of an attempt before it, so a restart charges nothing twice.
An ended run keeps a word of state for another ``quiet`` seconds, then none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.session import shared_folder

OUT = "run string, lines long, errors long, trying string, more long, status string"
_OUT = [c.split()[0] for c in OUT.split(", ")]
_RUN, _NEW = ("next", "rest", "lines", "errors", "trying", "charged", "status"), (1, "", 0, 0, None, 0, "running")
# A fixed value of a checkpoint: into how many keys runs are put.
BUCKETS = 256


def applied(state: dict[str, Any], event: dict[str, Any]) -> None:
    """One event of a running run: a logged line, what is being tried, or the end; starts and beats change nothing."""
    kind = event.get("type")
    if kind == "log":
        state["lines"] += 1
        state["errors"] += bool(event.get("error"))
        state["trying"] = None
    elif kind == "trying":
        state["trying"] = event.get("line")
    elif kind == "end":
        state["status"], state["trying"] = ("stopped" if event.get("error") == "stopped" else "done"), None
    state["charged"] = max(state["charged"], event.get("spent") or 0)


def fed(state: dict[str, Any], piece: str) -> None:
    """The next piece of a run: whole lines are applied until the run ends, the rest is kept."""
    *lines, state["rest"] = (state["rest"] + piece).split("\n")
    for line in lines:
        if state["status"] != "running":
            break
        try:
            event = json.loads(line)
        except ValueError:
            event = None
        if isinstance(event, dict):
            applied(state, event)
        else:
            state["status"], state["trying"] = "lost", None
    if state["status"] != "running":
        state["rest"] = ""


def _first(running: dict[str, tuple[dict[str, Any], int, dict[int, str]]], over: dict[str, int]) -> int | None:
    """When the first of a bucket's runs is due."""
    return min([due for _, due, _ in running.values()] + list(over.values()), default=None)


class Follower(StatefulProcessor):
    """State of the runs of a bucket, in one value: those that run (their state, when they were quiet long enough, their waiting pieces by number) and those that are over (until when
    that is remembered). A run a key would be a dozen calls out of Python for each run and batch; a bucket's are a handful for all of its runs."""

    def __init__(self, quiet: int):
        self.quiet = 1000 * quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "runs string")

    def _held(self) -> tuple[dict[str, tuple[dict[str, Any], int, dict[int, str]]], dict[str, int]]:
        got = self.runs.get()
        running, over = json.loads(got[0]) if got else ([], [])
        return {run: (dict(zip(_RUN, state, strict=True)), due, {int(n): piece for n, piece in waiting.items()}) for run, state, due, waiting in running}, dict(over)

    def _hold(self, running: dict[str, tuple[dict[str, Any], int, dict[int, str]]], over: dict[str, int], timer: int | None) -> None:
        """``timer``: the one that is set."""
        if running or over:
            rows = [(run, list(state.values()), due, waiting) for run, (state, due, waiting) in running.items()]
            self.runs.update((json.dumps((rows, list(over.items())), separators=(",", ":")),))
        else:
            self.runs.clear()
        due = _first(running, over)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came: dict[str, tuple[dict[int, str], list[int]]] = {}
        for part in rows:
            for run, n, piece, ms in zip(part["run"].tolist(), part["seq"].tolist(), part["piece"].tolist(), part["ms"].tolist(), strict=True):
                pieces, times = came.setdefault(run, ({}, []))
                pieces[n] = piece
                times.append(ms)
        running, over = self._held()
        timer, out = _first(running, over), []
        for run, (pieces, times) in came.items():
            if run in over:
                continue
            state, _, waiting = running.pop(run, None) or (dict(zip(_RUN, _NEW, strict=True)), 0, {})
            charged, due = state["charged"], max(0, *times) + self.quiet
            waiting |= {n: piece for n, piece in pieces.items() if n >= state["next"]}  # a piece that came twice is one
            while state["status"] == "running" and state["next"] in waiting:
                fed(state, waiting.pop(state["next"]))
                state["next"] += 1
            if state["status"] == "running":
                running[run] = state, due, waiting
            else:
                over[run] = due
            out.append((run, state["lines"], state["errors"], state["trying"], state["charged"] - charged, state["status"]))
        self._hold(running, over, timer)
        if out:
            yield pd.DataFrame(out, columns=_OUT)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        running, over = self._held()
        over = {run: until for run, until in over.items() if until >= now}
        out = []
        for run, (state, due, _) in list(running.items()):
            if due < now:
                del running[run]
                over[run] = due + self.quiet
                out.append((run, state["lines"], state["errors"], None, 0, "left"))
        self._hold(running, over, None)  # the one that went off is none any more
        if out:
            yield pd.DataFrame(out, columns=_OUT)

    def close(self) -> None:
        pass


def follow(pieces: DataFrame, quiet: int, late: str = "1 hour") -> DataFrame:
    """An update for each run that a batch touches, from a stream of ``pieces`` (``run``, ``seq``, ``ts``, ``piece``). Needs the RocksDB state store."""
    timed = pieces.withColumns({"ms": F.unix_millis("ts"), "bucket": F.pmod(F.xxhash64("run"), F.lit(BUCKETS))}).withWatermark("ts", late)
    return timed.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Follower(quiet), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def text_pieces(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """The stream of pieces of a folder of text files ``RUN.SEQ.ndjson``, a piece a file, however it cuts lines; its time is the file's."""
    files = spark.readStream.option("pathGlobFilter", "*.ndjson").option("maxFilesPerTrigger", files_a_batch).text(folder, wholetext=True)
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.(\d+)\.ndjson$", 1)
    seq = F.regexp_extract("_metadata.file_name", r"^(.*)\.(\d+)\.ndjson$", 2).cast("long")
    return files.select(name.alias("run"), seq.alias("seq"), F.col("_metadata.file_modification_time").alias("ts"), F.col("value").alias("piece"))


def _keep(updates: str, batch: DataFrame, number: int) -> None:
    batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")


def followed(spark: SparkSession, pieces: DataFrame, quiet: int, folder: str | None = None, keep=_keep) -> DataFrame:
    """All updates of everything that is there, with their ``batch``; with the same ``folder`` a later call goes on where the last one ended, or was killed."""
    folder = folder or shared_folder(spark)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = follow(pieces, quiet).writeStream.outputMode("update").foreachBatch(partial(keep, f"{folder}/updates")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.schema(f"{OUT}, batch int").parquet(f"{folder}/updates")


def standing(updates: DataFrame) -> DataFrame:
    """Each run as its last update leaves it, and all it was charged."""
    last = F.max_by(F.struct("lines", "errors", "trying", "status"), "batch").alias("u")
    return updates.groupBy("run").agg(last, F.sum("more").alias("charged")).select("run", "u.*", "charged")
