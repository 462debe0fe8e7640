"""Streaming forms of the ingest operators. Batch is what they extend: the results agree once all input is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_seen(stream: DataFrame, content: Column, time: str, delay: str = "1 hour") -> DataFrame:
    """One row of each content within the watermark, whose state is dropped behind it."""
    keyed = stream.withColumn("_key", F.sha2(content.cast("string"), 256))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(stream: DataFrame, time: str, by: list[str], window: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums by window, for late rows up to ``delay``."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return stream.withWatermark(time, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Read what is there, write Parquet, end; a further call goes on from the checkpoint."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
