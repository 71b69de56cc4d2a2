"""Feature and term counts kept up to date from streams of annotation rows.

The engine itself is a batch one; this keeps its marginals current between batches. Every micro-batch writes
its own counts under its batch id, so a batch that is run again after a failure replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def keep_counts(stream: DataFrame, column: str, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Count rows of a stream (distinct upstream) by `column` into folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(column).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """(column, n): the counts of all batches so far."""
    return spark.read.parquet(folder).groupBy(column).agg(F.sum("n").alias("n"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key in tumbling windows, rows later than `late` being dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
