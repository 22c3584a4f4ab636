"""Structured Streaming counterparts: windows, duplicates and failure streaks over arriving files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.session import shared_folder, ship

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Event files as they arrive in a folder, with a time that watermarks can use."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("time", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events of each type and window."""
    one = events.withWatermark("time", late).groupBy(F.window("time", width), "event_type")
    return one.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "6 hours") -> DataFrame:
    """Runs of a user's events with no gap."""
    one = events.withWatermark("time", late).groupBy(F.session_window("time", gap), "user_id").agg(F.count("*").alias("n"))
    return one.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "7 days") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("time", late).dropDuplicatesWithinWatermark([key])


def longest_streaks(events: DataFrame, bad: str = "error") -> DataFrame:
    """user_id, longest: the longest run of `bad` events of each user so far, kept as state between batches."""
    ship(events.sparkSession)

    def step(key, frames, state: GroupState):
        run, longest = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["time", "event_id"])
        for kind in rows["event_type"]:
            run = run + 1 if kind == bad else 0
            longest = max(longest, run)
        state.update((run, longest))
        yield pd.DataFrame({"user_id": [key[0]], "longest": [longest]})

    return events.select("user_id", "event_id", "event_type", "time").groupBy("user_id").applyInPandasWithState(step, "user_id long, longest long", "run long, longest long", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what there is, and give its table: the last batch in complete mode, else all batches.

    Each batch is written to the shared folder under its number, so that one that is run again replaces itself.
    """
    spark = stream.sparkSession
    at, numbers = f"{shared_folder(spark)}/{name}", set()

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table/{number}")
        numbers.add(number)

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    wanted = sorted(numbers)[-1:] if mode == "complete" else sorted(numbers)
    return spark.read.schema(stream.schema).parquet(*(f"{at}/table/{n}" for n in wanted)) if wanted else spark.createDataFrame([], stream.schema)
