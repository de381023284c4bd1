"""Block maxima of a stream: windowed aggregation with a watermark, into tables that the batch operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_maxima(rows: DataFrame, series: str, ts: str, value: str, block: str = "1 day", late: str = "1 day") -> DataFrame:
    """series_id, block and q of every closed block; rows later than the watermark are left out."""
    df = rows.select(F.col(series).cast("string").alias("series_id"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("q")).filter("q > 0")
    g = df.withWatermark("ts", late).groupBy(F.window("ts", block).alias("w"), "series_id").agg(F.max("q").alias("q"))
    return g.select("series_id", F.col("w.start").alias("block"), "q")


def start(maxima: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run a stream of maxima into Parquet until all present input is read; the checkpoint makes restarts exact."""
    return maxima.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
