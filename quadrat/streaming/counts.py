"""Incremental counts, an extension: particles that arrive in micro-batches, by window, list and tomogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour", keys: tuple[str, ...] = ("list_id", "tomo_id")) -> DataFrame:
    """keys, start, end, n and total of value; rows later than the watermark are left out. The same plan runs on a static table."""
    w = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = w.groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def appended(stream: DataFrame, path: str, checkpoint: str):
    """Rows appended to a Parquet table, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
