"""Click counts kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(clicks: DataFrame, keys: list[str], time: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts of clicks by keys and tumbling window; what is later than ``late`` is left out."""
    timed = clicks.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), *keys).agg(F.count("*").alias("n_clicks"))


def append_counts(counts: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends finished windows to a Parquet table; with ``once`` what is there is processed and the query ends."""
    writer = counts.select("window.start", "window.end", *(c for c in counts.columns if c != "window")).writeStream.outputMode("append").format("parquet")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def totals(table: DataFrame, keys: list[str]) -> DataFrame:
    """Counts over all windows of the table."""
    return table.groupBy(*keys).agg(F.sum("n_clicks").alias("n_clicks"))
