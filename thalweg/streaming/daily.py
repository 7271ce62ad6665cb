"""The monthly means of complete months (A6) and daily means as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_means(events: DataFrame, keys: list[str], ts: str, value: str, late: str = "2 days") -> DataFrame:
    """Means of tumbling days, final once the watermark has passed; works on streams and on tables."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    day = F.window(ts, "1 day")
    return rows.groupBy(*keys, day.alias("w")).agg(F.avg(value).alias("value"), F.count(value).alias("n")).select(*keys, F.to_date("w.start").alias("day"), "value", "n")


def run_available(stream: DataFrame, table: str, checkpoint: str):
    """Writes what there is to an in-memory table or Parquet folder and ends."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.format("parquet").start(table) if "/" in table else writer.format("memory").queryName(table).start())
