"""Structured Streaming over result logs and events: roll-ups, windows, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def result_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Results as they are appended to a folder of JSON lines."""
    return spark.readStream.schema(schema).json(folder)


def live_difficulty(results: DataFrame) -> DataFrame:
    """Running count and mean reward by difficulty (complete or update mode)."""
    return results.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n_tasks"), F.avg("reward").alias("reward"))


def event_time(events: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, size: str, by: str, time: str = "ts", slide: str | None = None) -> DataFrame:
    """(start, by, n, total) by windows of event time."""
    w = F.window(F.col(time).cast("timestamp"), size, slide) if slide else F.window(F.col(time).cast("timestamp"), size)
    return events.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, by: str, time: str = "ts") -> DataFrame:
    """(by, start, end, n) of runs of events that are less than ``gap`` apart."""
    w = F.session_window(F.col(time).cast("timestamp"), gap)
    return events.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dedup(events: DataFrame, key: str, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return event_time(events, time, late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Everything there is now into a table below ``path``, with the stream's checkpoint beside it; returns a reader of it.

    Each micro-batch overwrites (complete) or adds to the table (append), so nothing passes through the driver.
    """
    table = f"{path}/table"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(table)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table)
