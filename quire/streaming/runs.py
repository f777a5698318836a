"""Run events as a stream: built-in streaming aggregates a run, and spend charged once however often a run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import shared_folder

OUT = "run string, lines long, errors long, charged long, last string"


def fold(events: DataFrame) -> DataFrame:
    """Lines, errors, the last event by id and the largest report so far (``charged``) of each run of ``events`` (``run``, ``event_id``,
    ``event_type``, ``dollars``, ``sent``); beats don't count. An update for each run that a batch touches."""
    given = events.where("event_type is not null and event_type <> 'beat'")
    charged = F.coalesce(F.max(F.when(F.col("sent"), F.col("dollars"))), F.lit(0).cast("long"))
    return given.groupBy("run").agg(F.count("*").alias("lines"), F.count_if(F.col("event_type") == "error").alias("errors"), charged.alias("charged"), F.max_by("event_type", "event_id").alias("last"))


def charges(updates: DataFrame) -> DataFrame:
    """What each update adds to the ledger (``more``): a report charges only its increase over the run's earlier ones."""
    return updates.withColumn("more", F.col("charged") - F.coalesce(F.lag("charged").over(Window.partitionBy("run").orderBy("batch")), F.lit(0)))


def run_to_end(spark: SparkSession, updates: DataFrame) -> DataFrame:
    """Process everything available and return the updates as a table with their ``batch``; a rerun of a batch replaces it."""
    folder = shared_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    query = updates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{OUT}, batch int").parquet(f"{folder}/updates")
