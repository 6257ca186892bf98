"""Structured Streaming over the run log: deduplication, hourly windows, and retries as state."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import views
from dossier.session import read_table
from dossier.session import shared_folder as session_folder

LATE = "2 hours"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors can write, below the session's checkpoint folder."""
    return os.path.join(session_folder(spark), f"stream-{uuid.uuid4().hex}")


def event_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """The events table as a stream, ``files`` files per batch."""
    schema = read_table(spark, folder, "events").schema
    path = os.path.join(folder, "events.parquet")
    if not path.startswith(("file:", "hdfs:", "s3")) and os.path.isfile(path):
        path = os.path.join(folder, "events.parque[t]")  # a stream reads folders or patterns
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def as_runs(events: DataFrame, late: str = LATE) -> DataFrame:
    """The stream's events as runs, second deliveries within the watermark dropped, and what comes more than ``late`` behind."""
    stages = F.array(*(F.lit(s) for s in views.STAGES))
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    return rows.select("at", F.col("user_id").alias("document"), F.get(stages, (F.col("event_id") % 7).cast("int")).alias("stage"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"))


def hourly(runs: DataFrame) -> DataFrame:
    return runs.groupBy("stage", F.window("at", "1 hour").alias("window")).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failure").alias("failures"))


def hourly_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly windows of the whole table through a stream that ends when the table is used up.

    Each batch's new totals are appended as a table of their own batch; a batch that is run again
    writes the same files again. The last total of a window counts. Files come in any order, so the watermark waits for
    as long as the table lasts.
    """
    first, last = read_table(spark, folder, "events").agg(F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp")).first()
    wait = f"{int((last - first).total_seconds()) // 3600 + 2 if first else 2} hours"
    target, state = shared_folder(spark), shared_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number:08d}")

    counted = hourly(as_runs(event_stream(spark, folder), wait))
    stream = counted.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
    stream.awaitTermination()
    rows = spark.read.parquet(target)
    return views.latest(rows, ["stage", "window"], F.desc("batch")).drop("batch")


def failure_streaks(runs: DataFrame) -> DataFrame:
    """(document, streak): running length of each document's failures, as a stateful stream operator."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        for batch in batches:
            for status in batch.sort_values("at")["status"]:
                streak = streak + 1 if status == "failure" else 0
        state.update((streak,))
        yield pd.DataFrame({"document": [key[0]], "streak": [streak]})

    return runs.groupBy("document").applyInPandasWithState(step, "document long, streak long", "streak long", "update", "NoTimeout")
